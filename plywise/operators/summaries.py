"""Participant summaries and the leaderboards, comparisons and audits built on them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plywise.functions import labels
from plywise.functions.stats import (
    count_if,
    mean_or_null,
    rate,
    score_percent,
    weighted_avg,
    weighted_avg_known,
    wilson_high,
    wilson_low,
)
from plywise.operators.selection import first_rows
from plywise.session import stored

# Defaults of a run without a prompt, low-sample bound, hidden aliases.
DEFAULT_MODE, DEFAULT_LEGALITY = "strict", "open"
LOW_SAMPLE_GAMES = 10
HIDDEN_ALIASES = ("gemma4:12b",)
ENGINE_TYPE = "stockfish"
NO_CPL_ORDER = 1e9

COLORS = ("white", "black")
_MOVE_MEASURES = ("moves", "retries", "latency", "evaluated", "accurate", "cpl_sum", "cpl_n",
                  "blunders", "mistakes", "inaccuracies")
_ATTEMPT_MEASURES = ("attempts", "malformed", "illegal", "tokens")


def classify_evaluations(evaluations: DataFrame) -> DataFrame:
    """Add loss and class to raw engine scores."""
    loss = labels.centipawn_loss(*[F.col(c) for c in ("eval_before_cp", "eval_after_cp", "mate_before", "mate_after")])
    return evaluations.withColumn("centipawn_loss", loss).withColumn(
        "classification", labels.move_class(F.col("centipawn_loss"), F.col("mate_before"), F.col("mate_after"))
    )


def game_sides(games: DataFrame, participants: DataFrame) -> DataFrame:
    """One row per game and known side."""
    sides = games.select(
        "game_id", "run_id", "result", "termination_reason",
        F.explode(_side_array([])).alias("side"),
    ).select("game_id", "run_id", "result", "termination_reason", "side.color", "side.participant_id")
    known = sides.where(F.col("participant_id").isNotNull())
    return known.join(participants.select("participant_id"), "participant_id", "left_semi")


def _side_array(measures: Sequence[str]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(color).alias("color"),
            F.col(f"{color}_participant_id").alias("participant_id"),
            *[F.col(f"{color}_{m}").alias(m) for m in measures],
        )
        for color in COLORS
    ])


def run_modes(runs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Mode and legality mode of every run, with the defaults of a run without a prompt."""
    return runs.join(prompts.select("prompt_id", "mode", "legality_mode"), "prompt_id", "left").select(
        "run_id",
        F.coalesce("mode", F.lit(DEFAULT_MODE)).alias("mode"),
        F.coalesce("legality_mode", F.lit(DEFAULT_LEGALITY)).alias("legality_mode"),
        "opening_suite_id",
    )


def _by_color(color: Column, measures: dict[str, Column]) -> list[Column]:
    return [
        F.sum(F.when(color == side, value)).alias(f"{side}_{name}")
        for side in COLORS for name, value in measures.items()
    ]


def move_facts(moves: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Per game: plies and the move and evaluation measures of both sides."""
    kind = F.col("classification")
    per_move = evaluations.groupBy("move_id").agg(
        F.count(F.lit(1)).alias("evaluated"),
        count_if(kind.isin("best", "good")).alias("accurate"),
        F.sum(F.col("centipawn_loss").cast("long")).alias("cpl_sum"),
        F.count("centipawn_loss").alias("cpl_n"),
        count_if(kind == "blunder").alias("blunders"),
        count_if(kind == "mistake").alias("mistakes"),
        count_if(kind == "inaccuracy").alias("inaccuracies"),
    )
    joined = moves.select(*MOVE_COLUMNS).join(
        per_move, "move_id", "left"
    )
    measures = {
        "moves": F.lit(1), "retries": F.col("retries_used"), "latency": F.col("latency_total_ms"),
        **{m: F.col(m) for m in _MOVE_MEASURES[3:]},
    }
    return joined.groupBy("game_id").agg(F.count(F.lit(1)).alias("plies"), *_by_color(F.col("color"), measures))


def attempt_facts(attempts: DataFrame, token_usage: DataFrame) -> DataFrame:
    """Per game: attempts, rejected attempts and tokens of both sides (side by ply parity)."""
    with_tokens = attempts.select(*ATTEMPT_COLUMNS).join(
        token_usage.select("attempt_id", "total_tokens"), "attempt_id", "left"
    )
    measures = {
        "attempts": F.lit(1),
        "malformed": (~F.col("parse_ok")).cast("int"),
        "illegal": (F.col("parse_ok") & ~F.col("legal_ok")).cast("int"),
        "tokens": F.coalesce(F.col("total_tokens"), F.lit(0)).cast("long"),
    }
    return with_tokens.groupBy("game_id").agg(*_by_color(labels.ply_color(F.col("ply")), measures))


def participant_summary(
    games: DataFrame,
    participants: DataFrame,
    runs: DataFrame,
    prompts: DataFrame,
    moves: DataFrame,
    evaluations: DataFrame,
    attempts: DataFrame,
    token_usage: DataFrame,
    run_id: int | None = None,
    few_games: bool = False,
) -> DataFrame:
    """One row per participant and colour.

    With ``run_id``, or if ``games`` are few of all (``few_games``), the games, moves and attempts in question are written
    first, and facts of others are left out before they are evaluated, joined or summed; each table is read once.

    Moves and attempts are reduced to one row per game on their own, so no fact multiplies
    another; games, move facts and attempt facts then meet on game_id, and everything above
    the game is a partial aggregate on (participant, colour).
    """
    scoped = games.where(F.col("run_id").isNotNull() if run_id is None else F.col("run_id") == run_id)
    scoped = scoped.join(runs.select("run_id"), "run_id", "left_semi").select(*GAME_COLUMNS)
    if run_id is not None or few_games:
        scoped = stored(scoped, "games")
        moves = stored(moves.select(*MOVE_COLUMNS).join(scoped.select("game_id"), "game_id", "left_semi"), "moves")
        attempts = stored(attempts.select(*ATTEMPT_COLUMNS).join(scoped.select("game_id"), "game_id", "left_semi"), "attempts")
        evaluations = evaluations.join(moves.select("move_id"), "move_id", "left_semi")
        token_usage = token_usage.join(attempts.select("attempt_id"), "attempt_id", "left_semi")
    sides = side_measures(scoped, moves, evaluations, attempts, token_usage)
    return finished_summary(total_measures(sides), participants, runs, prompts)


MOVE_COLUMNS = ("move_id", "game_id", "color", "retries_used", "latency_total_ms")
ATTEMPT_COLUMNS = ("attempt_id", "game_id", "ply", "parse_ok", "legal_ok")
GAME_COLUMNS = ("game_id", "run_id", "white_participant_id", "black_participant_id", "result", "termination_reason")


def side_measures(games: DataFrame, moves: DataFrame, evaluations: DataFrame, attempts: DataFrame, token_usage: DataFrame) -> DataFrame:
    """One row for each game and known side: what it adds to the summary of its participant and colour."""
    facts = games.select(*GAME_COLUMNS).join(move_facts(moves, evaluations), "game_id", "left").join(
        attempt_facts(attempts, token_usage), "game_id", "left"
    )
    measures = _MOVE_MEASURES + _ATTEMPT_MEASURES
    sides = facts.select(
        "game_id", "run_id", "result", "termination_reason", "plies", F.explode(_side_array(measures)).alias("s")
    ).select("game_id", "run_id", "result", "termination_reason", "plies", "s.*")
    outcome = labels.outcome(F.col("result"), F.col("color"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    forfeit = (F.col("termination_reason") == "forfeit_invalid") & (outcome == "loss")
    return sides.where(F.col("participant_id").isNotNull()).select(
        "participant_id", "color", "game_id", "run_id", F.lit(1).cast("long").alias("games_played"),
        *[flag(outcome == what).alias(name) for name, what in OUTCOME_COUNTS.items()], flag(forfeit).alias("forfeit_invalid_count"),
        *[F.coalesce(m, F.lit(0)).cast(LATENCY_TYPE if m == "latency" else "long").alias(m) for m in ("plies", *measures)],
    )


#: Exact, so that what is added can be taken out again.
LATENCY_TYPE = "decimal(28,6)"
OUTCOME_COUNTS = {"wins": "win", "draws": "draw", "losses": "loss", "unfinished": "unfinished"}
#: The sums of a summary; rows of them add up, and may be taken out again with the sign turned.
MEASURES = ("games_played", *OUTCOME_COUNTS, "forfeit_invalid_count", "plies", *_MOVE_MEASURES, *_ATTEMPT_MEASURES)


def total_measures(sides: DataFrame) -> DataFrame:
    """Sums by participant and colour, and the run of the participant's first game."""
    return sides.groupBy("participant_id", "color").agg(
        F.min(F.when(F.col("games_played") > 0, F.struct("game_id", "run_id"))).alias("first"), *[F.sum(m).alias(m) for m in MEASURES])


def merged_totals(totals: DataFrame) -> DataFrame:
    """Totals of disjoint sets of games, or of changes, as one."""
    return totals.groupBy("participant_id", "color").agg(F.min("first").alias("first"), *[F.sum(m).alias(m) for m in MEASURES])


def finished_summary(totals: DataFrame, participants: DataFrame, runs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Rates, intervals and names of totals; participants and colours without a game are left out."""
    own = totals.where("games_played > 0").withColumn("first_run_id", F.col("first.run_id")).drop("first")
    return _finish(
        own.join(participants.select("participant_id", "run_id", "model_snapshot_id"), "participant_id")
        .join(run_modes(runs, prompts).withColumnRenamed("run_id", "first_run_id"), "first_run_id")
    )


def _finish(t: DataFrame) -> DataFrame:
    c = F.col
    n, attempts = c("games_played"), c("attempts")
    return t.select(
        (c("participant_id") * 2 + (c("color") == "black").cast("int")).alias("summary_id"),
        "run_id", "participant_id", "model_snapshot_id", "color", "mode", "legality_mode", "opening_suite_id",
        "games_played", "wins", "draws", "losses", "unfinished",
        rate(c("plies"), n).alias("avg_game_plies"),
        mean_or_null(c("cpl_sum"), c("cpl_n")).alias("avg_cpl"),
        c("evaluated").alias("evaluated_move_count"),
        rate(c("accurate"), c("evaluated")).alias("accuracy_rate"),
        "blunders", "mistakes", "inaccuracies",
        attempts.alias("attempt_count"),
        c("illegal").alias("illegal_attempts"), c("malformed").alias("malformed_attempts"),
        *_rate_with_interval("illegal_rate", c("illegal"), attempts),
        *_rate_with_interval("malformed_rate", c("malformed"), attempts),
        *_rate_with_interval("win_rate", c("wins"), n),
        (n < LOW_SAMPLE_GAMES).alias("low_sample"),
        rate(c("retries"), c("moves")).alias("avg_retries"),
        "forfeit_invalid_count",
        rate(c("latency").cast("double"), c("moves")).alias("avg_latency_ms"),
        c("tokens").alias("total_tokens"),
    )


def _rate_with_interval(name: str, count: Column, total: Column) -> list[Column]:
    return [
        rate(count, total).alias(name),
        wilson_low(count, total).alias(f"{name}_ci_low"),
        wilson_high(count, total).alias(f"{name}_ci_high"),
    ]


def _rollup() -> tuple[list[Column], list[Column]]:
    """Aggregates of a re-aggregation, and the intervals derived from the summed counts."""
    summed = ("games_played", "wins", "draws", "losses", "unfinished", "evaluated_move_count",
              "attempt_count", "illegal_attempts", "malformed_attempts", "total_tokens")
    by_games = F.col("games_played")
    aggregates = [F.sum(c).alias(c) for c in summed] + [
        weighted_avg_known(F.col("avg_cpl"), by_games).alias("avg_cpl"),
        weighted_avg(F.col("accuracy_rate"), F.col("evaluated_move_count")).alias("accuracy_rate"),
        weighted_avg(F.col("illegal_rate"), F.col("attempt_count")).alias("illegal_rate"),
        weighted_avg(F.col("malformed_rate"), F.col("attempt_count")).alias("malformed_rate"),
        *[weighted_avg(F.col(c), by_games).alias(c) for c in ("avg_game_plies", "avg_retries", "avg_latency_ms")],
    ]
    c = F.col
    derived = [
        rate(c("wins"), c("games_played")).alias("win_rate"),
        *[
            f(c(k), c(n)).alias(f"{name}_ci_{end}")
            for name, k, n in (("win_rate", "wins", "games_played"),
                               ("illegal_rate", "illegal_attempts", "attempt_count"),
                               ("malformed_rate", "malformed_attempts", "attempt_count"))
            for end, f in (("low", wilson_low), ("high", wilson_high))
        ],
        (c("games_played") < LOW_SAMPLE_GAMES).alias("low_sample"),
    ]
    return aggregates, derived


def run_comparison(summaries: DataFrame) -> DataFrame:
    """One row per run, newest first."""
    aggregates, derived = _rollup()
    return summaries.groupBy("run_id").agg(*aggregates).select("*", *derived).orderBy(F.desc("run_id"))


def model_comparison(
    summaries: DataFrame,
    participants: DataFrame,
    runs: DataFrame,
    snapshots: DataFrame,
    legality_mode: str | None = None,
    color: str | None = None,
    hidden: Iterable[str] = HIDDEN_ALIASES,
) -> DataFrame:
    """One row per model identity and legality mode; engines and hidden aliases are left out."""
    people = participants.select("participant_id", "opponent_type", "display_name").where(
        (F.col("opponent_type") != ENGINE_TYPE) & ~F.col("display_name").isin(*hidden)
    )
    rows = summaries if legality_mode is None else summaries.where(F.col("legality_mode") == legality_mode)
    if color not in (None, "all"):
        rows = rows.where(F.col("color") == color)
    joined = (
        rows.join(people, "participant_id")
        .join(runs.select("run_id", F.col("created_at").alias("played_at")), "run_id")
        .join(
            snapshots.select(
                "model_snapshot_id", "quantization", "context_window", "sampler_params", "runtime_version",
                F.col("created_at").alias("snapshot_created_at"),
            ),
            "model_snapshot_id", "left",
        )
    )
    identity = F.when(
        F.col("model_snapshot_id").isNotNull(), F.concat(F.lit("snap:"), F.col("model_snapshot_id").cast("string"))
    ).otherwise(F.concat(F.lit("name:"), F.col("display_name")))
    first = F.struct(
        F.col("display_name").alias("label"), "model_snapshot_id", "snapshot_created_at",
        "quantization", "context_window", "sampler_params", "runtime_version",
    )
    aggregates, derived = _rollup()
    grouped = joined.groupBy(
        F.concat(identity, F.lit("|"), F.col("legality_mode")).alias("model_key"), "legality_mode"
    ).agg(
        F.min_by(first, "summary_id").alias("first"),
        F.min("played_at").alias("played_from"), F.max("played_at").alias("played_to"),
        F.sort_array(F.collect_set("run_id")).alias("run_ids"),
        *aggregates,
        *[F.sum(c).alias(c) for c in ("blunders", "mistakes", "inaccuracies", "forfeit_invalid_count")],
    )
    return (
        grouped.select("*", "first.*", F.size("run_ids").alias("run_count"),
                       F.lit(color or "all").alias("color"), *derived)
        .drop("first")
        .orderBy(*model_order())
    )


def filter_summaries(summaries: DataFrame, **equals: object) -> DataFrame:
    """Keep rows equal to every given value; None means no filter on that column."""
    allowed = {"run_id", "color", "mode", "legality_mode", "opening_suite_id", "model_snapshot_id"}
    unknown = set(equals) - allowed
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    for name, value in equals.items():
        if value is not None:
            summaries = summaries.where(F.col(name) == value)
    return summaries


def leaderboard(summaries: DataFrame, participants: DataFrame, **filters: object) -> DataFrame:
    names = participants.select("participant_id", F.col("display_name").alias("participant"))
    return filter_summaries(summaries, **filters).join(names, "participant_id").orderBy(*leaderboard_order())


def leaderboard_order() -> list[Column]:
    return [F.desc("run_id"), F.asc("legality_mode"), F.asc("color"), F.asc_nulls_last("avg_cpl"), F.asc("illegal_rate")]


def model_order() -> list[Column]:
    return [F.desc("win_rate"), F.coalesce("avg_cpl", F.lit(NO_CPL_ORDER)), F.col("model_key")]


def newest_order() -> list[Column]:
    return [F.desc("started_at"), F.desc("game_id")]


def newest_games(games: DataFrame, limit: int | None = None) -> DataFrame:
    newest = first_rows(games, ["started_at", "game_id"], limit, descending=True)
    return newest.orderBy(*newest_order())


def run_ids_desc(games: DataFrame) -> DataFrame:
    return games.select("run_id").where(F.col("run_id").isNotNull()).distinct().orderBy(F.desc("run_id"))


def run_events(events: DataFrame, run_id: int | None = None) -> DataFrame:
    rows = events if run_id is None else events.where(F.col("run_id") == run_id)
    return rows.orderBy("run_id", "event_id")


# Matrix views ---------------------------------------------------------------------

# Metric and the direction in which it is better.
MATRIX_METRICS = {
    "games_played": "none", "win_rate": "higher", "illegal_rate": "lower", "malformed_rate": "lower",
    "accuracy_rate": "higher", "avg_cpl": "lower", "blunders_per_game": "lower", "avg_game_plies": "none",
    "avg_retries": "lower", "avg_latency_ms": "lower", "forfeit_rate": "lower", "total_tokens": "none",
}


def with_matrix_metrics(comparison: DataFrame) -> DataFrame:
    """Per-game metrics of a comparison row; NULL when there is no sample."""
    c = F.col
    games, attempts = c("games_played"), c("attempt_count")
    per_game = lambda name: c(name) / F.when(games != 0, games)
    return comparison.select(
        "*",
        per_game("blunders").alias("blunders_per_game"),
        per_game("forfeit_invalid_count").alias("forfeit_rate"),
        (c("avg_game_plies") / 2).alias("avg_moves"),
        score_percent(games, c("wins"), c("draws")).alias("score_percent"),
        F.when(games != 0, c("win_rate")).alias("shown_win_rate"),
        F.when(attempts != 0, c("illegal_rate")).alias("shown_illegal_rate"),
        F.when(attempts != 0, c("malformed_rate")).alias("shown_malformed_rate"),
        F.when(c("evaluated_move_count") != 0, c("accuracy_rate")).alias("shown_accuracy_rate"),
    )


def matrix_best(comparison: DataFrame) -> DataFrame:
    """Long cells (model_key, metric, value, is_best); all ties win, two known values needed."""
    shown = {"win_rate", "illegal_rate", "malformed_rate", "accuracy_rate"}
    source = with_matrix_metrics(comparison)
    cells = source.select(
        "model_key",
        F.inline(F.array(*[
            F.struct(
                F.lit(m).alias("metric"), F.lit(d).alias("direction"),
                F.col(f"shown_{m}" if m in shown else m).cast("double").alias("value"),
            )
            for m, d in MATRIX_METRICS.items()
        ])),
    )
    best = cells.groupBy("metric").agg(
        F.count("value").alias("known"), F.max("value").alias("highest"), F.min("value").alias("lowest")
    )
    target = F.when(F.col("direction") == "higher", F.col("highest")).when(F.col("direction") == "lower", F.col("lowest"))
    wins = F.coalesce((F.col("known") >= 2) & (F.col("value") == target), F.lit(False))
    return cells.join(best, "metric").select("model_key", "metric", "direction", "value", wins.alias("is_best"))


def config_fields(row: DataFrame) -> Column:
    """Short configuration descriptors of a model row, in display order."""
    number = lambda key: _plain_number(F.get_json_object("sampler_params", f"$.{key}"))
    return F.array_compact(F.array(
        F.when(F.col("quantization") != "", F.col("quantization")),
        F.when(F.col("context_window") != 0, F.concat(F.lit("ctx "), F.col("context_window").cast("string"))),
        F.concat(F.lit("temp "), number("temperature")),
        F.concat(F.lit("top_p "), number("top_p")),
        F.concat(F.lit("pred "), number("num_predict")),
    ))


def _plain_number(text: Column) -> Column:
    value = text.try_cast("double")
    decimals = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), r"\.$", "")
    return F.when(value.isNull(), F.nullif(text, F.lit(""))).otherwise(decimals)


def model_labels(comparison: DataFrame) -> DataFrame:
    """Secondary line of every model: when it was played and only the settings that tell it
    apart from others of the same label; an id is added where lines still coincide."""
    rows = comparison.select(
        "model_key", "label", "model_snapshot_id", "run_ids", "run_count", "played_from", "played_to",
        config_fields(comparison).alias("fields"),
    )
    siblings = rows.groupBy("label").agg(F.count(F.lit(1)).alias("siblings"))
    shared = rows.select("label", "model_key", F.explode("fields").alias("field"))
    usage = shared.distinct().groupBy("label", "field").agg(F.count(F.lit(1)).alias("users"))
    distinct_fields = (
        rows.select("model_key", "label", F.posexplode("fields").alias("pos", "field"))
        .join(usage, ["label", "field"]).join(siblings, "label")
        .where((F.col("siblings") > 1) & (F.col("users") < F.col("siblings")))
        .groupBy("model_key")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "field"))).alias("own"))
    )
    day = lambda c: F.date_format(c, "d MMM yyyy")
    played = F.when(day("played_from") != day("played_to"),
                    F.concat_ws(" – ", day("played_from"), day("played_to"))).otherwise(day("played_to"))
    runs = F.when(F.col("run_count") > 1, F.concat(F.col("run_count").cast("string"), F.lit(" runs")))
    meta = rows.join(distinct_fields, "model_key", "left").withColumn(
        "meta",
        F.concat_ws(" · ", F.array(played, runs), F.transform("own", lambda f: f["field"])),
    )
    twins = meta.groupBy("label", "meta").agg(F.count(F.lit(1)).alias("twins"))
    own_id = F.when(
        F.col("model_snapshot_id").isNotNull(), F.concat(F.lit("snap #"), F.col("model_snapshot_id").cast("string"))
    ).otherwise(F.concat(F.lit("run #"), F.col("run_ids")[0].cast("string")))
    final = F.when(F.col("twins") < 2, F.col("meta")).otherwise(
        F.concat_ws(" · ", F.nullif(F.col("meta"), F.lit("")), own_id)
    )
    return meta.join(twins, ["label", "meta"]).select("model_key", "label", final.alias("meta"))


# Audits ---------------------------------------------------------------------------

OUTCOMES = ("win", "draw", "loss", "unfinished")
CLASSES = ("best", "good", "inaccuracy", "mistake", "blunder", "mate_missed", "mate_position", "unknown")


def termination_breakdown(games: DataFrame, participants: DataFrame, opponent_type: str = "model") -> DataFrame:
    """Per run and termination reason: outcomes from the side of one participant type."""
    people = participants.where(F.col("opponent_type") == opponent_type)
    sides = game_sides(games, people).withColumn("outcome", labels.outcome(F.col("result"), F.col("color")))
    return sides.groupBy("run_id", "termination_reason").agg(
        *[count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count(F.lit(1)).alias("sides")
    )


def cpl_distribution(moves: DataFrame, evaluations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and median loss, large losses, and mean latency."""
    joined = moves.join(evaluations.select("move_id", "centipawn_loss"), "move_id", "left")
    cpl = F.col("centipawn_loss")
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("moves"), F.count(cpl).alias("evaluated"),
        F.avg(cpl).alias("mean_cpl"), F.percentile(cpl, 0.5).alias("median_cpl"),
        count_if(cpl > 300).alias("above_300"), count_if(cpl > 1000).alias("above_1000"),
        F.avg("latency_total_ms").alias("mean_latency_ms"),
    )


def mate_label_audit(moves: DataFrame, games: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Per run: stored class against the class recomputed from the stored scores."""
    mates = evaluations.where(F.col("mate_before").isNotNull() | F.col("mate_after").isNotNull())
    fresh = classify_evaluations(mates.select("move_id", "eval_before_cp", "eval_after_cp", "mate_before", "mate_after",
                                              F.col("classification").alias("stored")))
    located = fresh.join(moves.select("move_id", "game_id"), "move_id").join(games.select("game_id", "run_id"), "game_id")
    return located.groupBy("run_id", "stored").agg(
        *[count_if(F.col("classification") == k).alias(k) for k in ("mate_missed", "mate_position")]
    )
