"""Example sets from game records and judged moves: funnel, sampling, relabelling, mining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plywise.functions import labels
from plywise.functions.stats import count_if
from plywise.functions.text import example_key, strip
from plywise.operators.ordering import (
    counters,
    evenly_spaced,
    first_per_key,
    hash_order,
    last_per_key,
    running_total,
    unit_hash,
    with_one_row,
)
from plywise.operators.selection import first_rows
from plywise.session import stored
from plywise.sources.gamefiles import tag

# Speed rule of the funnel and its reasons.
SLOW_SECONDS = 180
ASSUMED_MOVES = 40
FAST_LABELS = "bullet"
SLOW_LABELS = "blitz|rapid|classical|correspondence"
NO_POSITIONS = "no_valid_sampled_positions"
ERROR_FREE_CPL = 1_000_000


# Funnel ---------------------------------------------------------------------------


def is_rated(headers: Column) -> Column:
    rated = F.lower(strip(tag(headers, "Rated")))
    by_event = F.startswith(F.lower(strip(tag(headers, "Event"))), F.lit("rated "))
    return F.when(rated.isin("true", "yes", "1"), True).when(rated.isin("false", "no", "0"), False).otherwise(by_event)


def is_slow_enough(headers: Column) -> Column:
    """Named speed of the event first, else the estimated duration of the time control."""
    event = F.lower(strip(tag(headers, "Event")))
    control = strip(tag(headers, "TimeControl"))
    whole = r"^\s*([+-]?\d+)\s*\+\s*([+-]?\d+)\s*$"
    part = lambda i: F.regexp_extract(control, whole, i).try_cast("long")
    seconds = part(1) + ASSUMED_MOVES * part(2)
    return (
        F.when(event.rlike(FAST_LABELS), False).when(event.rlike(SLOW_LABELS), True)
        .otherwise(F.coalesce(seconds >= SLOW_SECONDS, F.lit(False)))
    )


def has_min_elo(headers: Column, min_elo: int) -> Column:
    elo = lambda name: F.when(strip(tag(headers, name)).rlike(r"^\d+$"), strip(tag(headers, name))).try_cast("long")
    white, black = elo("WhiteElo"), elo("BlackElo")
    known = white.isNotNull() & black.isNotNull()
    return F.coalesce(known & (F.least(white, black) >= min_elo), F.lit(False))


def skip_reason(headers: Column, plies: Column, min_elo: int, min_plies: int) -> Column:
    """First rule a game fails, or NULL."""
    return (
        F.when(~is_rated(headers), "unrated")
        .when(~is_slow_enough(headers), "time_control_too_fast_or_unknown")
        .when(~has_min_elo(headers, min_elo), "elo_below_threshold_or_missing")
        .when(F.lower(strip(tag(headers, "Termination"))) != "normal", "non_normal_termination")
        .when(plies < min_plies, "too_few_plies")
    )


def game_split(game_key: Column, val_ratio: float, seed: int) -> Column:
    """One split per game, so no game is in both."""
    return F.when(unit_hash(f"{seed}-split", game_key) < val_ratio, "val").otherwise("train")


def row_mode(constrained_ratio: float, seed: int, *keys: Column) -> Column:
    return F.when(unit_hash(f"{seed}-mode", *keys) < constrained_ratio, "constrained").otherwise("open")


def capped_samples(
    games: DataFrame, max_per_game: int, max_examples: int, index: str = "source_game_index", plies: str = "plies"
) -> DataFrame:
    """Sampled move indices per kept game, in game order, up to a total number of examples.

    The game on the boundary is sampled again with what is left; later games are not seen. A running total reads its rows
    twice, so the games are written once.
    """
    want = stored(games.withColumn("_k", F.least(F.col(plies), F.lit(max_per_game)).cast("long")), "games")
    before = running_total(want, index, "_k", "_before")
    left = F.lit(max_examples) - F.col("_before")
    budget = F.least(F.lit(max_per_game).cast("long"), left).cast("int")
    return (
        before.where(left > 0)
        .withColumn("sample_indices", evenly_spaced(F.col(plies), budget))
        .drop("_k", "_before")
    )


def funnel_stats(games: DataFrame, split: str = "split", written: str = "written") -> DataFrame:
    """(metric, key, n) of a build: games seen and kept, examples per split, skips by reason.

    ``games(skip_reason, split, written)`` with ``written`` NULL for skipped games.
    """
    kept = F.col("skip_reason").isNull() & (F.col(written) > 0)
    reason = F.coalesce("skip_reason", F.when(F.coalesce(F.col(written), F.lit(0)) == 0, NO_POSITIONS))
    totals = games.agg(
        F.count(F.lit(1)).alias("games_seen"), count_if(kept).alias("games_kept"),
        *[F.coalesce(F.sum(F.when(kept & (F.col(split) == s), F.col(written))), F.lit(0)).alias(f"examples_{s}")
          for s in ("train", "val")],
    )
    flat = totals.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.lit("").alias("key"), F.col(c).cast("long").alias("n")) for c in totals.columns
    ])))
    return flat.unionByName(counters(games, {"skipped_games": reason}))


def example_rows(games: DataFrame, max_per_game: int | None = None) -> DataFrame:
    """Examples of games given as ordered move arrays (structs fen, san, uci): sampled moves
    with the game's split. Without ``max_per_game`` every position is one."""
    indices = evenly_spaced(F.size("moves"), F.size("moves") if max_per_game is None else max_per_game)
    picked = games.withColumn("i", F.explode(indices))
    here = F.element_at("moves", F.col("i") + 1)
    return picked.select(
        *[c for c in games.columns if c != "moves"], (F.col("i") + 1).alias("ply"),
        here["uci"].alias("move"), here["san"].alias("san"), here["fen"].alias("fen"),
        F.concat(F.lit('{"move":"'), here["uci"], F.lit('"}')).alias("completion"),
    )


# Relabelling ----------------------------------------------------------------------


def relabelled(rows: DataFrame, mode: str = "distill", max_cpl: int = 100, dedup: bool = True,
               order: str = "line_index") -> DataFrame:
    """Engine-labelled examples. ``distill`` replaces the move by the engine's best, ``filter``
    drops lossy moves. Exact duplicates of (prompt, completion) keep their first row.

    ``rows(prompt, move, san, completion, best_move_uci, best_move_san, human_centipawn_loss,
    human_classification, <order>)``.
    """
    kept = relabel_reasons(rows, mode, max_cpl).where(F.col("dropped").isNull()).drop("dropped")
    if mode == "distill":
        best = F.col("best_move_uci")
        kept = kept.withColumns({
            "completion": F.concat(F.lit('{"move":"'), best, F.lit('"}')), "move": best, "san": F.col("best_move_san"),
        })
    if not dedup:
        return kept
    return first_per_key(kept.withColumn("_key", example_key(F.col("prompt"), F.col("completion"))), ["_key"], [order]).drop("_key")


def relabel_reasons(rows: DataFrame, mode: str, max_cpl: int) -> DataFrame:
    if mode not in ("distill", "filter"):
        raise ValueError("mode must be 'distill' or 'filter'")
    lossy = (F.col("human_classification") == "mate_missed") | F.coalesce(
        F.col("human_centipawn_loss") > max_cpl, F.lit(False)
    )
    reason = (
        F.when(F.col("best_move_uci").isNull(), "no_best_move") if mode == "distill" else F.when(lossy, "filtered")
    )
    return rows.withColumn("dropped", F.when(F.col("human_classification").isNull(), "invalid_row").otherwise(reason))


def relabel_stats(rows: DataFrame, mode: str = "distill", max_cpl: int = 100, dedup: bool = True) -> DataFrame:
    """One row of counters, the agreement with the engine (over rows read) and the mean loss."""
    marked = relabel_reasons(rows, mode, max_cpl)
    valid = F.col("human_classification").isNotNull()
    kept = F.col("dropped").isNull()
    completion = (
        F.concat(F.lit('{"move":"'), F.col("best_move_uci"), F.lit('"}')) if mode == "distill" else F.col("completion")
    )
    written = F.countDistinct(F.when(kept, example_key(F.col("prompt"), completion))) if dedup else count_if(kept)
    one = marked.agg(
        F.count(F.lit(1)).alias("rows_read"), written.alias("rows_written"),
        count_if(F.col("dropped") == "invalid_row").alias("dropped_invalid_row"),
        count_if(F.col("dropped") == "no_best_move").alias("dropped_no_best_move"),
        count_if(F.col("dropped") == "filtered").alias("dropped_filtered"),
        count_if(kept).alias("_kept"),
        count_if(valid & (F.col("best_move_uci") == F.col("move"))).alias("human_matches_engine"),
        F.bround(F.avg(F.when(valid, F.col("human_centipawn_loss"))), 2).alias("human_avg_cpl"),
    )
    rate = F.bround(F.col("human_matches_engine") / F.when(F.col("rows_read") != 0, F.col("rows_read")), 4)
    return one.select(
        "*", (F.col("_kept") - F.col("rows_written")).alias("dropped_duplicate"), rate.alias("human_engine_agreement_rate")
    ).drop("_kept")


# Mining and gates -----------------------------------------------------------------


def mined_errors(moves: DataFrame, games: DataFrame, evaluations: DataFrame, prompts: DataFrame,
                 run_ids: Sequence[int] | None, min_cpl: int = 250, blunders: bool = True,
                 mate_missed: bool = True, high_mistakes: bool = True) -> DataFrame:
    """Judged moves that match any enabled error rule, with ``error_order`` (an orderable
    struct: kind, large loss first, then run, game, ply). ``run_ids`` None means every run."""
    rules: list[Column] = []
    kind, cpl = F.col("classification"), F.col("centipawn_loss")
    if blunders:
        rules.append(kind == "blunder")
    if mate_missed:
        rules.append(kind == "mate_missed")
    if high_mistakes:
        rules.append(F.coalesce(cpl >= min_cpl, F.lit(False)))
    if not rules:
        raise ValueError("at least one error type must be enabled")
    if run_ids is not None and not run_ids:
        raise ValueError("at least one run id is required")
    wrong = rules[0]
    for rule in rules[1:]:
        wrong = wrong | rule
    scoped = games.select("game_id", "run_id")
    if run_ids is not None:
        scoped = scoped.where(F.col("run_id").isin(*run_ids))
    bad = evaluations.where(wrong).select("move_id", "best_move_uci", "centipawn_loss", "classification")
    found = (
        bad.join(moves.select("move_id", "game_id", "ply", F.col("fen_before").alias("fen"), "accepted_uci"), "move_id")
        .join(scoped, "game_id").join(prompts, "move_id", "left")
    )
    priority = F.when(kind == "blunder", 0).when(kind == "mate_missed", 1).otherwise(2)
    order = F.struct(
        priority.alias("kind"), (-F.coalesce(cpl, F.lit(ERROR_FREE_CPL))).alias("loss"), "run_id", "game_id", "ply"
    )
    return found.withColumn("error_order", order)


def _survives() -> Column:
    missing = F.coalesce(F.col("prompt"), F.lit("")) == ""
    played_best = F.coalesce(F.col("best_move_uci") == F.col("accepted_uci"), F.lit(False))
    return F.when(missing, "missing_prompt").when(played_best, "best_equals_accepted")


def error_examples(errors: DataFrame, max_examples: int | None = None) -> DataFrame:
    """First usable error of every position, most severe first, up to the maximum."""
    usable = errors.withColumn("_drop", _survives()).where(F.col("_drop").isNull()).drop("_drop")
    first = first_per_key(usable, ["fen"], ["error_order"])
    first = first_rows(first, ["error_order"], max_examples)
    move = F.coalesce("best_move_uci", "accepted_uci")
    return first.select(
        "prompt", F.concat(F.lit('{"move":"'), move, F.lit('"}')).alias("completion"), move.alias("move"), "fen",
        F.lit("train").alias("split"), F.lit("arena_error_mined").alias("source"),
        F.col("run_id").alias("source_run_id"), F.col("game_id").alias("source_game_id"),
        F.col("move_id").alias("source_move_id"), "ply", F.col("accepted_uci").alias("model_bad_move"),
        F.col("best_move_uci").alias("stockfish_best_move"), F.col("centipawn_loss").alias("model_centipawn_loss"),
        F.col("classification").alias("model_classification"), "error_order",
    )


def error_stats(errors: DataFrame, max_examples: int | None = None) -> DataFrame:
    """(metric, key, n) of the mining. With a maximum, only rows up to the last written one count,
    as a reader that stops there would see. Errors are read for the order, the examples and the counts, so they are written
    once, with a mark in place of their prompt."""
    mark = F.when(F.coalesce("prompt", F.lit("")) != "", F.lit("x"))
    errors = stored(errors.withColumn("prompt", mark), "errors")
    written = error_examples(errors, max_examples)
    seen = errors.withColumn("_drop", _survives())
    if max_examples is not None:
        edge = written.agg(F.max("error_order").alias("_edge"), F.count(F.lit(1)).alias("_n"))
        bounded = with_one_row(seen, edge)
        seen = bounded.where((F.col("_n") < max_examples) | (F.col("error_order") <= F.col("_edge")))
    one = seen.agg(
        F.count(F.lit(1)).alias("candidates"),
        count_if(F.col("_drop") == "missing_prompt").alias("dropped_missing_prompt"),
        count_if(F.col("_drop") == "best_equals_accepted").alias("dropped_best_equals_accepted"),
        count_if(F.col("_drop").isNull()).alias("_usable"),
    )
    both = with_one_row(one, written.agg(F.count(F.lit(1)).alias("written")))
    flat = both.withColumn("dropped_duplicate_fen", F.col("_usable") - F.col("written")).drop("_usable")
    totals = flat.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.lit("").alias("key"), F.col(c).cast("long").alias("n")) for c in flat.columns
    ])))
    return totals.unionByName(
        counters(written, {"by_run": F.col("source_run_id"), "by_classification": F.col("model_classification")})
    )


def is_trigger(min_cpl: int = 250, blunders: bool = True) -> Column:
    """The prediction lost much or blundered."""
    high = F.coalesce(F.col("centipawn_loss") >= min_cpl, F.lit(False))
    return high | (F.lit(blunders) & F.coalesce(F.col("classification") == "blunder", F.lit(False)))


def gate_triggers(predictions: DataFrame, dataset: DataFrame, min_cpl: int = 250, blunders: bool = True,
                  row_order: str = "row_index") -> DataFrame:
    """First prediction per known position that lost much or blundered (in file, line order),
    with its dataset row and ``n_triggers``, how many such predictions the position has.

    Predictions are reduced to their position before the lookup, so a position that most of
    them share is one row in the join. The last dataset row of a position is the one that counts."""
    known = last_per_key(dataset.select("fen", "prompt", "completion", "move", row_order), ["fen"], [row_order]).drop(row_order)
    fields = ("file_ord", "line_ord", "parsed_move", "centipawn_loss", "classification", "gate_source")
    first = predictions.where(is_trigger(min_cpl, blunders)).groupBy("fen").agg(F.min(F.struct(*fields)).alias("_first"), F.count(F.lit(1)).alias("n_triggers"))
    return first.select("fen", "n_triggers", "_first.*").join(known, "fen")


def tactical_gate(triggers: DataFrame, max_examples: int | None = None) -> DataFrame:
    """First trigger of every position over the ordered files, up to the maximum; the order and the rows are two reads, so
    triggers are written once where there is one."""
    triggers = triggers if max_examples is None else stored(triggers, "triggers")
    first = first_rows(triggers, ["file_ord", "line_ord"], max_examples)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return first.select(
        "prompt", "fen", text("completion").alias("completion"), text("move").alias("move"),
        F.lit("tactical_gate").alias("split"), "gate_source", text("parsed_move").alias("gate_trigger_move"),
        F.col("centipawn_loss").alias("gate_trigger_cpl"), text("classification").alias("gate_trigger_classification"),
        "file_ord", "line_ord",
    )


def gate_stats(predictions: DataFrame, triggers: DataFrame, gate: DataFrame) -> DataFrame:
    """(metric, key, n) of an uncapped gate."""
    one = with_one_row(
        with_one_row(predictions.agg(F.count(F.lit(1)).alias("prediction_rows")),
                     triggers.agg(F.coalesce(F.sum("n_triggers"), F.lit(0)).alias("_triggers"))),
        gate.agg(F.count(F.lit(1)).alias("selected_rows")),
    ).withColumn("dropped_duplicate_fen", F.col("_triggers") - F.col("selected_rows")).drop("_triggers")
    flat = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.lit("").alias("key"), F.col(c).cast("long").alias("n")) for c in one.columns
    ])))
    return flat.unionByName(
        counters(gate, {"by_source": F.col("gate_source"), "by_classification": F.col("gate_trigger_classification")})
    )


# Mixing, paging, audits -----------------------------------------------------------


def normalized(rows: DataFrame, source: Column) -> DataFrame:
    """Five text fields: prompt, fen, completion, move, source."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(
        F.col("prompt").cast("string").alias("prompt"), F.col("fen").cast("string").alias("fen"),
        text("completion").alias("completion"), text("move").alias("move"), source.alias("source"),
    )


def hash_sample(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, chosen by hash order."""
    return first_rows(rows, [hash_order(seed, *[F.col(k) for k in keys]), *keys], n)


def mixed_rows(broad: DataFrame, tactical: DataFrame, n_broad: int, repeats: int, seed: int, key: str,
               shuffle: bool = True) -> DataFrame:
    """A broad sample and the tactical rows repeated, in hash-shuffled order."""
    sample = normalized(hash_sample(broad, n_broad, seed, key), F.lit("broad"))
    again = tactical.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(repeats)))) if repeats > 0 else None
    out = sample
    if again is not None:
        out = out.unionByName(normalized(again, F.concat(F.lit("tactical_gate_r"), F.col("_r").cast("string"))))
    return out.orderBy(hash_order(f"{seed}-mix", *[F.col(c) for c in out.columns])) if shuffle else out


def position_records(rows: DataFrame, split: str | None = "train", origin: str = "input") -> DataFrame:
    """Positions of example rows, optionally of one split; blank aliases fall through."""
    kept = rows if split is None else rows.where(F.col("split") == split)
    names = [F.nullif(F.col(c), F.lit("")) for c in ("fen_before", "fen") if c in rows.columns]
    return kept.select(F.coalesce(*names).alias("fen"), F.col("seq"), F.lit(origin).alias("origin")).where("fen IS NOT NULL")


def page_positions(records: Sequence[DataFrame], offset: int = 0, max_positions: int | None = None) -> DataFrame:
    """Distinct positions over ordered sources, first seen first; skip ``offset``, take the maximum."""
    out: DataFrame | None = None
    for i, part in enumerate(records):
        tagged = part.select("fen", "seq", "origin", F.lit(i).alias("source_ord"))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("at least one source of positions is required")
    seen = first_per_key(out, ["fen"], ["source_ord", "seq"])
    return first_rows(seen, ["source_ord", "seq"], max_positions, offset)


def split_audit(examples: DataFrame) -> DataFrame:
    """Per split: rows, games, modes, prompt versions and answers of the wrong form."""
    return examples.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("game_id").alias("games"),
        count_if(F.col("legality_mode") == "open").alias("open_rows"),
        count_if(F.col("legality_mode") == "constrained").alias("constrained_rows"),
        F.countDistinct("prompt_version").alias("prompt_versions"),
        count_if(~F.coalesce(F.col("completion").rlike(r'^\{"move":"[^"]+"\}$'), F.lit(False))).alias("bad_completions"),
    )


def shared_games(examples: DataFrame, left: str = "train", right: str = "val") -> DataFrame:
    """Number of games that are in both splits; must be zero."""
    of = lambda s: examples.where(F.col("split") == s).select("game_id")
    return of(left).intersect(of(right)).agg(F.count(F.lit(1)).alias("shared_games"))
