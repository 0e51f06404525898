"""Game-level views: timelines, histories, retries, reports, schedules.

A game and a ply are groups bounded by the rules of the game (draw rules end a game after a
few thousand plies) and by the retry limit, so windows inside them stay small. Positions are
not bounded that way and never get a window here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plywise.functions import labels, prompts
from plywise.functions.stats import count_if
from plywise.functions.text import base_identity, compact
from plywise.operators.ordering import evenly_spaced
from plywise.sources.gamefiles import player_tag

# Annotation personas, label of a move without evaluation.
PERSONAS = ("aggressive", "positional", "defensive", "risk-taking", "technician")
NOT_EVALUATED = "not evaluated"


def timeline(moves: DataFrame, evaluations: DataFrame, annotations: DataFrame, attempts: DataFrame,
             token_usage: DataFrame) -> DataFrame:
    """Moves with their ordered evaluations, annotations and (accepted) attempts as arrays."""
    evals = evaluations.groupBy("move_id").agg(
        F.array_sort(F.collect_list(F.struct("evaluation_id", "classification", "centipawn_loss", "eval_after_cp")))
        .alias("engine_evaluations")
    )
    notes = annotations.groupBy("move_id").agg(
        F.array_sort(F.collect_list(F.struct("annotation_id", "persona", "commentary"))).alias("annotations")
    )
    tries = (
        attempts.where(F.col("move_id").isNotNull())
        .select("attempt_id", "move_id", "ply", "attempt_number", "parse_ok", "legal_ok")
        .join(token_usage.select("attempt_id", "total_tokens"), "attempt_id", "left")
        .groupBy("move_id")
        .agg(F.array_sort(F.collect_list(
            F.struct("ply", "attempt_number", "attempt_id", "parse_ok", "legal_ok", "total_tokens"))).alias("attempts"))
    )
    out = moves
    for part in (evals, notes, tries):
        out = out.join(part, "move_id", "left")
    return out


def runtime_stats(moves: DataFrame, attempts: DataFrame, token_usage: DataFrame) -> DataFrame:
    """Per game and colour: tokens, retries, rejected attempts, mean latency, last known usage."""
    tries = (
        attempts.where(F.col("move_id").isNotNull()).select("attempt_id", "move_id", "attempt_number", "legal_ok")
        .join(token_usage.select("attempt_id", F.col("total_tokens").alias("tokens")), "attempt_id", "left")
    )
    per_move = tries.groupBy("move_id").agg(
        F.sum("tokens").alias("tokens"), count_if(~F.col("legal_ok")).alias("invalid"),
        F.max(F.when(F.col("tokens").isNotNull(), F.struct("attempt_number", "tokens"))).alias("last"),
    )
    return (
        moves.select("move_id", "game_id", "color", "ply", "retries_used", "latency_total_ms")
        .join(per_move, "move_id", "left")
        .groupBy("game_id", "color")
        .agg(
            F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
            F.sum("retries_used").alias("retries"),
            F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid_attempts"),
            F.max(F.when(F.col("last").isNotNull(), F.struct("ply", "last")))["last"]["tokens"].alias("last_usage"),
            F.avg("latency_total_ms").alias("average_latency_ms"),
        )
    )


def move_pairs(moves: DataFrame) -> DataFrame:
    """One row per move number with the white and the black move."""
    number = F.ceil(F.col("ply") / 2).cast("int")
    san = lambda color: F.max(F.when(F.col("color") == color, F.col("accepted_san"))).alias(color)
    return moves.groupBy("game_id", number.alias("number")).agg(san("white"), san("black"))


def evaluation_series(moves: DataFrame, evaluations: DataFrame) -> DataFrame:
    """First evaluation of every move; points without any value are dropped."""
    first = evaluations.groupBy("move_id").agg(
        F.min_by(F.struct("eval_after_cp", "centipawn_loss"), "evaluation_id").alias("e")
    )
    return (
        moves.select("move_id", "game_id", "ply", F.col("accepted_san").alias("label")).join(first, "move_id")
        .select("game_id", "ply", "label", F.col("e.eval_after_cp").alias("after"), F.col("e.centipawn_loss").alias("cpl"))
        .where(F.col("after").isNotNull() | F.col("cpl").isNotNull())
    )


def player_names(games: DataFrame, participants: DataFrame) -> DataFrame:
    """Display names of both players, else the name tag of the stored record."""
    names = participants.select("participant_id", "display_name")
    out = games
    for color, header in (("white", "White"), ("black", "Black")):
        side = names.select(F.col("participant_id").alias(f"{color}_participant_id"), F.col("display_name").alias(f"_{color}"))
        out = out.join(side, f"{color}_participant_id", "left").withColumn(
            f"{color}_player", F.coalesce(F.col(f"_{color}"), player_tag(F.col("pgn"), header))
        ).drop(f"_{color}")
    return out


def first_prompts(attempts: DataFrame) -> DataFrame:
    """First stored prompt of every move, by attempt number."""
    stored = attempts.where(F.col("move_id").isNotNull() & F.col("raw_prompt").isNotNull())
    return stored.groupBy("move_id").agg(F.min_by("raw_prompt", "attempt_number").alias("prompt"))


def match_reports(games: DataFrame, moves: DataFrame, evaluations: DataFrame, annotations: DataFrame) -> DataFrame:
    """One Markdown report per game."""
    notes = annotations.groupBy("move_id").agg(
        F.array_sort(F.collect_list(F.struct("annotation_id", "persona", "commentary"))).alias("notes")
    )
    dash = F.lit("—")
    comment = F.array_join(F.transform("notes", lambda n: F.concat(F.lit("**"), n["persona"], F.lit(":** "), n["commentary"])), "<br>")
    line = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            F.col("ply").cast("string"),
            F.concat(F.col("accepted_san"), F.lit(" `"), F.col("accepted_uci"), F.lit("`")),
            F.coalesce("classification", dash),
            F.coalesce(F.col("centipawn_loss").cast("string"), dash),
            F.col("retries_used").cast("string"),
            F.format_string("%.1f ms", "latency_total_ms"),
            F.coalesce(F.nullif(comment, F.lit("")), dash),
        ),
        F.lit(" |"),
    )
    rows = (
        moves.join(evaluations.select("move_id", "classification", "centipawn_loss"), "move_id", "left")
        .join(notes, "move_id", "left")
        .select("game_id", "ply", line.alias("line"))
        .groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("ply", "line"))).alias("lines"))
    )
    # Layout of the report.
    layout = [
        "# Match Report — game {game_id}", "", "Result: {result}", "Termination: {termination}",
        "Final FEN: `{final_fen}`", "", "## PGN", "", "```pgn", "{pgn}", "```", "", "## Move Timeline", "",
        "| Ply | Move | Eval | CPL | Retries | Latency | Commentary |",
        "| ---: | --- | --- | ---: | ---: | ---: | --- |",
    ]
    head = prompts.render(layout, {
        "game_id": F.col("game_id"), "result": F.col("result"),
        "termination": prompts.or_none(F.col("termination_reason"), "unknown"),
        "final_fen": F.coalesce("final_fen", F.lit("")), "pgn": F.coalesce("pgn", F.lit("")),
    })
    body = F.array_join(F.transform("lines", lambda r: F.concat(F.lit("\n"), r["line"])), "")
    return games.join(rows, "game_id", "left").select(
        "game_id", F.concat(head, F.coalesce(body, F.lit("")), F.lit("\n")).alias("report")
    )


def annotation_backlog(moves: DataFrame, annotations: DataFrame, evaluations: DataFrame, persona: str) -> DataFrame:
    """Moves this persona has not commented yet, with their evaluation label and prompt."""
    if persona not in PERSONAS:
        raise ValueError(f"unknown persona: {persona}")
    done = annotations.where(F.col("persona") == persona).select("move_id")
    todo = moves.join(done, "move_id", "left_anti").join(
        evaluations.select("move_id", F.col("classification").alias("evaluation_label")), "move_id", "left"
    ).withColumn("evaluation_label", F.coalesce("evaluation_label", F.lit(NOT_EVALUATED)))
    values = {c: F.col(c) for c in ("fen_before", "accepted_san", "accepted_uci", "evaluation_label")}
    prompt = prompts.reasoning_prompt({**values, "persona": F.lit(persona)})
    return todo.withColumn("prompt", prompt).withColumn("raw_prompt_hash", F.sha2("prompt", 256))


def opening_schedule(matches: DataFrame, lines: DataFrame) -> DataFrame:
    """Games of every match: its opening lines, each in both orientations, cycled to the count.

    ``matches(run_id, suite_id, competitor_a, competitor_b, game_count)``; a NULL count plays
    every pairing once, a count of zero or less nothing. ``lines(suite_id, line_ord, name)``.
    """
    sizes = lines.groupBy("suite_id").agg(F.count(F.lit(1)).alias("n_lines"))
    wanted = F.coalesce("game_count", F.col("n_lines") * 2)
    slots = (
        matches.join(sizes, "suite_id").where(wanted > 0)
        .withColumn("game_no", F.explode(F.sequence(F.lit(0), wanted.cast("int") - 1)))
        .withColumn("_slot", F.pmod(F.col("game_no"), F.col("n_lines") * 2))
        .withColumn("line_ord", F.floor(F.col("_slot") / 2).cast("int"))
    )
    swapped = F.pmod(F.col("_slot"), F.lit(2)) == 1
    return slots.join(lines, ["suite_id", "line_ord"]).select(
        "run_id", "game_no", F.col("name").alias("opening"),
        F.when(swapped, F.col("competitor_b")).otherwise(F.col("competitor_a")).alias("white"),
        F.when(swapped, F.col("competitor_a")).otherwise(F.col("competitor_b")).alias("black"),
    )


def pair_footprints(pairs: DataFrame, footprints: DataFrame, budget_gb: float) -> DataFrame:
    """Memory event of every model pair: exceeds, unknown or fits. Engine and random players
    raise no event."""
    named = pairs.where(~F.col("competitor_a").isin("random", "stockfish") & ~F.col("competitor_b").isin("random", "stockfish"))
    for side in ("a", "b"):
        named = named.withColumn(f"model_{side}", base_identity(F.col(f"competitor_{side}"))).join(
            footprints.select(F.col("model").alias(f"model_{side}"), F.col("vram_gb").alias(f"vram_{side}")),
            f"model_{side}", "left",
        )
    total = F.col("vram_a") + F.col("vram_b")
    unknown = F.array_compact(F.array(*[F.when(F.col(f"vram_{s}").isNull(), F.col(f"model_{s}")) for s in ("a", "b")]))
    kind = (
        F.when(total > budget_gb, "model_swap_warning")
        .when(F.size(unknown) > 0, "model_footprint_unknown").otherwise("model_pair_fit")
    )
    return named.select(
        *[c for c in pairs.columns], "model_a", "model_b", total.alias("total_vram_gb"), unknown.alias("unknown_models"),
        kind.alias("event_kind"),
        F.when(kind == "model_swap_warning", "warning").otherwise("info").alias("severity"),
    )


# Histories ------------------------------------------------------------------------


def sampled_history(moves: DataFrame, per_game: int) -> DataFrame:
    """Evenly spaced moves of every game, each with what was played before it.

    The game's moves are gathered once (a game is bounded); prefixes are cut only for the
    sampled plies, so no prefix is stored for the others. ``moves(game_id, ply, san, uci)``.
    """
    whole = moves.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("ply", "san", "uci"))).alias("m"))
    sampled = whole.withColumn("i", F.explode(evenly_spaced(F.size("m"), per_game)))
    return _with_history(sampled)


def full_history(moves: DataFrame) -> DataFrame:
    """Every move with what was played before it."""
    whole = moves.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("ply", "san", "uci"))).alias("m"))
    return _with_history(whole.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("m") - 1))))


def _with_history(indexed: DataFrame) -> DataFrame:
    prior = F.slice(F.col("m"), F.lit(1), F.col("i"))
    own = F.filter(prior, lambda _, j: F.pmod(j, F.lit(2)) == F.pmod(F.col("i"), F.lit(2)))
    pair = lambda x: F.concat(x["san"], F.lit("/"), x["uci"])
    here = F.element_at("m", F.col("i") + 1)
    return indexed.select(
        "game_id", here["ply"].alias("ply"), here["san"].alias("san"), here["uci"].alias("uci"),
        F.array_join(F.transform(prior, lambda x: x["san"]), " ").alias("san_history"),
        F.array_join(F.transform(own, pair), ", ").alias("own_moves"),
        F.when(F.col("i") > 0, pair(F.try_element_at("m", F.col("i")))).alias("last_opponent_move"),
    )


def retry_features(attempts: DataFrame, max_retries: int) -> DataFrame:
    """Feedback each attempt was given, and failures and latency up to it, inside one ply."""
    ply = Window.partitionBy("game_id", "ply").orderBy("attempt_number")
    so_far = ply.rowsBetween(Window.unboundedPreceding, 0)
    before = lambda c: F.lag(c).over(ply)
    failed = (~F.col("legal_ok")).cast("int")
    return attempts.select(
        "attempt_id", "game_id", "ply", "attempt_number", "legal_ok",
        before("error_type").alias("feedback_error"),
        before("parsed_move").alias("feedback_move"),
        F.when(F.col("attempt_number") > 1, max_retries + 2 - F.col("attempt_number")).alias("remaining_retries"),
        (F.sum(failed).over(so_far) - failed).cast("int").alias("failed_before"),
        F.sum("latency_ms").over(so_far).alias("latency_total_ms"),
    )


def accepted_from_attempts(attempts: DataFrame) -> DataFrame:
    """Per ply with a legal attempt: retries used and total latency up to that attempt."""
    features = retry_features(attempts, 0)
    return features.where("legal_ok").select(
        "game_id", "ply", F.col("failed_before").alias("retries_used"), "latency_total_ms"
    )


def strategy_memory(moves: DataFrame) -> DataFrame:
    """Memory a side holds before each of its moves.

    ``moves(game_id, ply, san, uci, rationale, objective, opponent_threats, pieces_to_improve,
    avoid)``. A text field keeps its last non-blank value; the rationale is replaced every move.
    """
    side = labels.ply_color(F.col("ply"))
    before = Window.partitionBy("game_id", side).orderBy("ply").rowsBetween(Window.unboundedPreceding, -1)
    kept = lambda f: F.coalesce(
        F.last(F.when(F.trim(F.col(f)) != "", compact(F.col(f))), ignorenulls=True).over(before),
        prompts.render([prompts.INITIAL_MEMORY[f]], {"side": side}),
    )
    move = F.concat(F.col("san"), F.lit("/"), F.col("uci"), F.lit(": "))
    reason = F.when(
        F.coalesce(F.col("rationale"), F.lit("")) != "", compact(F.concat(move, F.col("rationale")))
    ).otherwise(F.concat(move, F.lit("no rationale returned")))
    last_reason = F.coalesce(F.last(reason).over(before), F.lit(prompts.NONE_TEXT))
    fields = [f for f in prompts.MEMORY_FIELDS if f != "last_rationale"]
    return moves.select("game_id", "ply", *[kept(f).alias(f) for f in fields], last_reason.alias("last_rationale"))


def proposal_totals(proposals: DataFrame, key: str = "request_id", order: str = "seq") -> DataFrame:
    """Telemetry of all proposals behind one answer: sums stay NULL when nothing was reported."""
    spoken = F.when(F.col("thinking") != "", F.struct(order, "thinking"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(spoken)), lambda t: t["thinking"]), "\n\n")
    return proposals.groupBy(key).agg(
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.nullif(joined, F.lit("")).alias("thinking"),
        F.bool_or("thinking_used").alias("thinking_used"),
    )
