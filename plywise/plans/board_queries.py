"""Leaderboards, comparisons, matrix views and audits on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plywise.functions import labels, text
from plywise.operators import summaries as ops
from plywise.plans.fixtures import Fixtures, with_views
from plywise.plans.registry import query, rounded, written
from plywise.plans.sqltext import ROLLUP, judged_sql, summary_sql


def evaluations(fx: Fixtures) -> DataFrame:
    return ops.classify_evaluations(fx.raw_evaluations)


def summary(fx: Fixtures) -> DataFrame:
    fx.number_lines()
    return ops.participant_summary(
        fx.games, fx.participants, fx.runs, fx.prompts, fx.moves, evaluations(fx), fx.attempts, fx.token_usage
    )


def models(fx: Fixtures) -> DataFrame:
    return ops.model_comparison(summary(fx), fx.participants, fx.runs, fx.snapshots)


def stored_models(fx: Fixtures) -> DataFrame:
    """The comparison, a few rows for each model, written once for queries that read it several times."""
    return written(fx, models(fx), "models")


# Latency means are exact ties at many digits (cents over a power of two); the nudge, far above
# the error of a sum and far below the last digit, makes both engines round them alike.
_NUDGE = 1e-9
_DOUBLES = ("avg_game_plies", "avg_cpl", "accuracy_rate", "illegal_rate", "illegal_rate_ci_low", "illegal_rate_ci_high",
            "malformed_rate", "malformed_rate_ci_low", "malformed_rate_ci_high", "win_rate", "win_rate_ci_low",
            "win_rate_ci_high", "avg_retries")
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _DOUBLES) + f", round(avg_latency_ms + {_NUDGE}, 6) AS avg_latency_ms"
_SUMMARY_COLUMNS = f"* REPLACE ({_ROUNDED})"


def _round_summary(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("avg_latency_ms", F.col("avg_latency_ms") + _NUDGE))


@query("participant_summary", summary_sql(f"SELECT {_SUMMARY_COLUMNS} FROM summary"))
def participant_summary(fx: Fixtures) -> DataFrame:
    return _round_summary(summary(fx))


@query("one_run_summary", summary_sql(f"SELECT {_SUMMARY_COLUMNS} FROM summary WHERE run_id = 10"))
def one_run_summary(fx: Fixtures) -> DataFrame:
    return _round_summary(ops.participant_summary(
        fx.games, fx.participants, fx.runs, fx.prompts, fx.moves, evaluations(fx), fx.attempts, fx.token_usage, run_id=10))


@query("run_comparison", summary_sql(f"SELECT run_id, {ROLLUP} FROM summary GROUP BY run_id"))
def run_comparison(fx: Fixtures) -> DataFrame:
    return _round_summary(ops.run_comparison(summary(fx)))


_MODELS = f"""
SELECT concat(CASE WHEN s.model_snapshot_id IS NULL THEN 'name:' || p.display_name ELSE 'snap:' || s.model_snapshot_id END,
              '|', s.legality_mode) AS model_key, s.legality_mode,
  arg_min(p.display_name, summary_id) AS label, min(s.model_snapshot_id) AS model_snapshot_id,
  min(r.created_at) AS played_from, max(r.created_at) AS played_to,
  list_sort(list_distinct(list(s.run_id))) AS run_ids,
  min(n.quantization) AS quantization, min(n.context_window) AS context_window, min(n.sampler_params) AS sampler_params,
  min(n.runtime_version) AS runtime_version, min(n.created_at) AS snapshot_created_at,
  CAST(sum(blunders) AS BIGINT) AS blunders, CAST(sum(mistakes) AS BIGINT) AS mistakes,
  CAST(sum(inaccuracies) AS BIGINT) AS inaccuracies, CAST(sum(forfeit_invalid_count) AS BIGINT) AS forfeit_invalid_count,
  {ROLLUP}
FROM summary s JOIN participants p USING (participant_id) JOIN runs r ON r.run_id = s.run_id
LEFT JOIN snapshots n ON n.model_snapshot_id = s.model_snapshot_id
WHERE p.opponent_type <> 'stockfish' AND p.display_name <> 'gemma4:12b'
GROUP BY 1, 2"""


@query("model_comparison", summary_sql("""
SELECT * REPLACE (CAST(CAST(played_from AS DATE) AS VARCHAR) AS played_from, CAST(CAST(played_to AS DATE) AS VARCHAR) AS played_to,
  CAST(CAST(snapshot_created_at AS DATE) AS VARCHAR) AS snapshot_created_at, array_to_string(run_ids, ',') AS run_ids),
  len(run_ids) AS run_count, 'all' AS color FROM models""", {"models": _MODELS}))
def model_comparison(fx: Fixtures) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    df = _round_summary(models(fx))
    fixed = {c: day(c) for c in ("played_from", "played_to", "snapshot_created_at")}
    fixed["run_ids"] = F.array_join(F.col("run_ids").cast("array<string>"), ",").alias("run_ids")
    fixed["run_count"] = F.col("run_count").cast("long").alias("run_count")
    return df.select(*[fixed.get(c, F.col(c)) for c in df.columns])


@query("model_comparison_white_open", summary_sql(f"""
SELECT model_key, label, games_played, wins, win_rate, avg_cpl FROM (
  SELECT concat(CASE WHEN s.model_snapshot_id IS NULL THEN 'name:' || p.display_name ELSE 'snap:' || s.model_snapshot_id END,
              '|', s.legality_mode) AS model_key, arg_min(p.display_name, summary_id) AS label, {ROLLUP}
  FROM summary s JOIN participants p USING (participant_id)
  WHERE p.opponent_type <> 'stockfish' AND p.display_name <> 'gemma4:12b' AND color = 'white' AND legality_mode = 'open'
  GROUP BY 1) q"""))
def model_comparison_white_open(fx: Fixtures) -> DataFrame:
    rows = ops.model_comparison(summary(fx), fx.participants, fx.runs, fx.snapshots, legality_mode="open", color="white")
    return _round_summary(rows).select("model_key", "label", "games_played", "wins", "win_rate", "avg_cpl")


@query("leaderboard", summary_sql(f"""
SELECT {_SUMMARY_COLUMNS} FROM (
  SELECT s.*, p.display_name AS participant FROM summary s JOIN participants p USING (participant_id)) q"""))
def leaderboard(fx: Fixtures) -> DataFrame:
    return _round_summary(ops.leaderboard(summary(fx), fx.participants))


@query("leaderboard_filtered", summary_sql("""
SELECT p.display_name AS participant, s.participant_id, run_id, games_played, wins, round(avg_cpl, 6) AS avg_cpl
FROM (SELECT * FROM summary WHERE color = 'black' AND mode = 'strict' AND legality_mode = 'constrained') s
JOIN (SELECT participant_id, display_name FROM participants) p USING (participant_id)"""))
def leaderboard_filtered(fx: Fixtures) -> DataFrame:
    rows = ops.leaderboard(summary(fx), fx.participants, color="black", mode="strict", legality_mode="constrained")
    return rounded(rows.select("participant", "participant_id", "run_id", "games_played", "wins", "avg_cpl"))


_CELLS = """
SELECT model_key, metric, direction, CAST(value AS DOUBLE) AS value FROM (
  SELECT model_key, unnest([
    {'metric': 'games_played', 'direction': 'none', 'value': games_played::DOUBLE},
    {'metric': 'win_rate', 'direction': 'higher', 'value': win_rate},
    {'metric': 'illegal_rate', 'direction': 'lower', 'value': CASE WHEN attempt_count > 0 THEN illegal_rate END},
    {'metric': 'malformed_rate', 'direction': 'lower', 'value': CASE WHEN attempt_count > 0 THEN malformed_rate END},
    {'metric': 'accuracy_rate', 'direction': 'higher', 'value': CASE WHEN evaluated_move_count > 0 THEN accuracy_rate END},
    {'metric': 'avg_cpl', 'direction': 'lower', 'value': avg_cpl},
    {'metric': 'blunders_per_game', 'direction': 'lower', 'value': round(blunders / games_played, 6)},
    {'metric': 'avg_game_plies', 'direction': 'none', 'value': avg_game_plies},
    {'metric': 'avg_retries', 'direction': 'lower', 'value': avg_retries},
    {'metric': 'avg_latency_ms', 'direction': 'lower', 'value': avg_latency_ms},
    {'metric': 'forfeit_rate', 'direction': 'lower', 'value': round(forfeit_invalid_count / games_played, 6)},
    {'metric': 'total_tokens', 'direction': 'none', 'value': total_tokens::DOUBLE}], recursive := true) FROM models) c"""


@query("matrix_best_cells", summary_sql("""
SELECT c.model_key, c.metric, c.direction, round(c.value, 6) AS value,
  coalesce(b.known >= 2 AND c.value = CASE c.direction WHEN 'higher' THEN b.top WHEN 'lower' THEN b.bottom END, false) AS is_best
FROM cells c JOIN (SELECT metric, count(value) AS known, max(value) AS top, min(value) AS bottom FROM cells GROUP BY 1) b USING (metric)""",
    {"models": _MODELS, "cells": _CELLS}))
def matrix_best_cells(fx: Fixtures) -> DataFrame:
    return rounded(ops.matrix_best(_round_summary(stored_models(fx))))


@query("model_headline_scores", summary_sql("""
SELECT model_key, round((wins + draws * 0.5) / games_played * 100, 6) AS score_percent,
  round(blunders / games_played, 6) AS blunders_per_game, avg_game_plies / 2 AS avg_moves FROM models""",
    {"models": _MODELS}))
def model_headline_scores(fx: Fixtures) -> DataFrame:
    return ops.with_matrix_metrics(_round_summary(models(fx))).select(
        "model_key", F.round("score_percent", 6).alias("score_percent"),
        F.round("blunders_per_game", 6).alias("blunders_per_game"), "avg_moves")


@query("model_label_lines", summary_sql("""
SELECT model_key, label, CASE WHEN twins < 2 THEN meta ELSE concat_ws(' · ', nullif(meta, ''),
    CASE WHEN model_snapshot_id IS NOT NULL THEN 'snap #' || model_snapshot_id ELSE 'run #' || run_ids[1] END) END AS meta
FROM (SELECT *, count(*) OVER (PARTITION BY label, meta) AS twins FROM lined) z""", {"models": _MODELS, "fielded": """
SELECT *, list_filter([quantization, 'ctx ' || context_window,
    'temp ' || json_extract_string(sampler_params, '$.temperature'), 'top_p ' || json_extract_string(sampler_params, '$.top_p')],
    lambda x: x IS NOT NULL) AS fields,
  count(*) OVER (PARTITION BY label) AS siblings FROM models""", "usage": """
SELECT label, field, count(*) AS users FROM (SELECT label, model_key, unnest(fields) AS field FROM fielded) u GROUP BY 1, 2""",
    "own": """
SELECT f.model_key, string_agg(x.field, ' · ' ORDER BY x.pos) AS own
FROM fielded f, LATERAL (SELECT unnest(f.fields) AS field, generate_subscripts(f.fields, 1) AS pos) x
JOIN usage u ON u.label = f.label AND u.field = x.field
WHERE f.siblings > 1 AND u.users < f.siblings GROUP BY 1""", "lined": """
SELECT f.model_key, f.label, f.model_snapshot_id, f.run_ids, concat_ws(' · ',
  CASE WHEN played_from <> played_to THEN strftime(played_from, '%-d %b %Y') || ' – ' || strftime(played_to, '%-d %b %Y')
       ELSE strftime(played_to, '%-d %b %Y') END,
  CASE WHEN len(run_ids) > 1 THEN len(run_ids) || ' runs' END, o.own) AS meta
FROM fielded f LEFT JOIN own o USING (model_key)"""}))
def model_label_lines(fx: Fixtures) -> DataFrame:
    return ops.model_labels(stored_models(fx))


@query("game_sides", with_views(["games", "participants"], """
SELECT game_id, run_id, result, termination_reason, color, participant_id FROM (
  SELECT *, 'white' AS color, white_participant_id AS participant_id FROM games
  UNION ALL SELECT *, 'black', black_participant_id FROM games) s
WHERE participant_id IN (SELECT participant_id FROM participants)"""))
def game_sides(fx: Fixtures) -> DataFrame:
    return ops.game_sides(fx.games, fx.participants)


@query("run_modes", with_views(["runs", "prompts"], """
SELECT run_id, coalesce(mode, 'strict') AS mode, coalesce(legality_mode, 'open') AS legality_mode, opening_suite_id
FROM runs LEFT JOIN prompts USING (prompt_id)"""))
def run_modes(fx: Fixtures) -> DataFrame:
    return ops.run_modes(fx.runs, fx.prompts)


@query("termination_breakdown", with_views(["games", "participants"], """
SELECT run_id, termination_reason, count(*) FILTER (outcome = 'win') AS win, count(*) FILTER (outcome = 'draw') AS draw,
  count(*) FILTER (outcome = 'loss') AS loss, count(*) FILTER (outcome = 'unfinished') AS unfinished, count(*) AS sides
FROM (SELECT g.run_id, termination_reason, CASE WHEN result = '*' THEN 'unfinished' WHEN result = '1/2-1/2' THEN 'draw'
        WHEN (result = '1-0') = (participant_id = white_participant_id) THEN 'win' ELSE 'loss' END AS outcome
      FROM games g JOIN participants p ON p.participant_id IN (g.white_participant_id, g.black_participant_id)
      WHERE p.opponent_type = 'model') x GROUP BY 1, 2"""))
def termination_breakdown(fx: Fixtures) -> DataFrame:
    return ops.termination_breakdown(fx.games, fx.participants)


@query("cpl_distribution", judged_sql(["moves"], """
SELECT color, count(*) AS moves, count(centipawn_loss) AS evaluated, round(avg(centipawn_loss), 6) AS mean_cpl,
  median(centipawn_loss) AS median_cpl, count(*) FILTER (centipawn_loss > 300) AS above_300,
  count(*) FILTER (centipawn_loss > 1000) AS above_1000, round(avg(latency_total_ms), 4) AS mean_latency_ms
FROM moves LEFT JOIN (SELECT move_id, centipawn_loss FROM evaluations) e USING (move_id) GROUP BY color"""))
def cpl_distribution(fx: Fixtures) -> DataFrame:
    return rounded(ops.cpl_distribution(fx.moves, evaluations(fx), ["color"]).withColumn(
        "mean_latency_ms", F.round("mean_latency_ms", 4)))


@query("evaluation_labels", judged_sql([], """
SELECT move_id, centipawn_loss, classification FROM evaluations"""))
def evaluation_labels(fx: Fixtures) -> DataFrame:
    return evaluations(fx).select("move_id", "centipawn_loss", "classification")


@query("mate_label_audit", judged_sql(["moves", "games"], """
SELECT run_id, stored, count(*) FILTER (classification = 'mate_missed') AS mate_missed,
  count(*) FILTER (classification = 'mate_position') AS mate_position
FROM (SELECT move_id, classification, CASE WHEN coalesce(mate_after, 0) < 0 THEN 'mate_missed' ELSE 'mate_position' END AS stored
      FROM evaluations WHERE mate_before IS NOT NULL OR mate_after IS NOT NULL) e
JOIN moves USING (move_id) JOIN games USING (game_id) GROUP BY 1, 2"""))
def mate_label_audit(fx: Fixtures) -> DataFrame:
    stored = F.when(F.coalesce("mate_after", F.lit(0)) < 0, "mate_missed").otherwise("mate_position")
    return ops.mate_label_audit(fx.moves, fx.games, fx.raw_evaluations.withColumn("classification", stored))


@query("newest_games", with_views(["games"], """
SELECT game_id, run_id, result, CAST(CAST(started_at AS DATE) AS VARCHAR) AS started_on
FROM games ORDER BY started_at DESC, game_id DESC LIMIT 20"""))
def newest_games(fx: Fixtures) -> DataFrame:
    day = F.date_format("started_at", "yyyy-MM-dd").alias("started_on")
    return ops.newest_games(fx.games.select("game_id", "run_id", "result", "started_at"), 20).select(
        "game_id", "run_id", "result", day)


@query("run_ids_desc", with_views(["games"], "SELECT DISTINCT run_id FROM games WHERE run_id IS NOT NULL"))
def run_ids_desc(fx: Fixtures) -> DataFrame:
    return ops.run_ids_desc(fx.games)


@query("run_events", with_views(["op_events"], "SELECT * FROM op_events"))
def run_events(fx: Fixtures) -> DataFrame:
    return ops.run_events(fx.op_events)


@query("run_events_of_one_run", with_views(["op_events"], "SELECT * FROM op_events WHERE run_id = 3"))
def run_events_of_one_run(fx: Fixtures) -> DataFrame:
    return ops.run_events(fx.op_events, run_id=3)


_NAMES = """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'reranked:openai:' || p_name WHEN 1 THEN 'deliberative:' || p_name
   WHEN 2 THEN CASE WHEN p_size > 25 THEN 'stockfish' ELSE 'reranked:random' END WHEN 3 THEN p_brand || ':' || p_name
   ELSE 'reranked:' END AS name FROM part"""


@query("participant_typing", "WITH named AS (" + _NAMES + """), based AS (
SELECT *, CASE WHEN name LIKE 'reranked:_%' THEN substr(name, 10) WHEN name LIKE 'deliberative:_%' THEN substr(name, 14)
  ELSE name END AS base FROM named)
SELECT p_partkey, base, CASE WHEN base IN ('random', 'stockfish') THEN base ELSE 'model' END AS opponent_type,
  CASE WHEN base LIKE 'openai:%' THEN 'openai' ELSE 'local' END AS provider,
  CASE WHEN base LIKE 'openai:%' THEN substr(base, 8) ELSE base END AS model FROM based""")
def participant_typing(fx: Fixtures) -> DataFrame:
    slot = F.pmod("p_partkey", F.lit(5))
    name = (
        F.when(slot == 0, F.concat(F.lit("reranked:openai:"), "p_name"))
        .when(slot == 1, F.concat(F.lit("deliberative:"), "p_name"))
        .when(slot == 2, F.when(F.col("p_size") > 25, "stockfish").otherwise("reranked:random"))
        .when(slot == 3, F.concat_ws(":", "p_brand", "p_name")).otherwise("reranked:")
    )
    base = text.base_identity(F.col("name"))
    return fx.part.select("p_partkey", name.alias("name")).select(
        "p_partkey", base.alias("base"), text.opponent_type(F.col("name")).alias("opponent_type"),
        text.provider(base).alias("provider"), text.provider_model(base).alias("model"))


@query("side_outcomes", with_views(["games"], """
SELECT color, outcome, count(*) AS n FROM (
  SELECT color, CASE WHEN result = '*' THEN 'unfinished' WHEN result NOT IN ('1-0', '0-1') THEN 'draw'
    WHEN (result = '1-0') = (color = 'white') THEN 'win' ELSE 'loss' END AS outcome
  FROM games, (SELECT 'white' AS color UNION ALL SELECT 'black') c) x GROUP BY 1, 2"""))
def side_outcomes(fx: Fixtures) -> DataFrame:
    sides = fx.games.select("result", F.explode(F.array(F.lit("white"), F.lit("black"))).alias("color"))
    return sides.groupBy("color", labels.outcome(F.col("result"), F.col("color")).alias("outcome")).agg(F.count("*").alias("n"))
