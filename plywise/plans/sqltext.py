"""Shared pieces of the check SQL."""

from __future__ import annotations

from plywise.plans.fixtures import with_views

Z = "1.959963984540054"


def low(k: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.0, {_center(k, n)} - {_margin(k, n)}) END"


def high(k: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE least(1.0, {_center(k, n)} + {_margin(k, n)}) END"


def _center(k: str, n: str) -> str:
    return f"((({k})::DOUBLE/({n}) + {Z}*{Z}/(2.0*({n}))) / (1 + {Z}*{Z}/({n})))"


def _margin(k: str, n: str) -> str:
    p = f"(({k})::DOUBLE/({n}))"
    return f"({Z} * sqrt(({p}*(1-{p}) + {Z}*{Z}/(4.0*({n})))/({n})) / (1 + {Z}*{Z}/({n})))"


def rate(k: str, n: str) -> str:
    return f"CASE WHEN ({n}) = 0 THEN 0.0 ELSE ({k})::DOUBLE / ({n}) END"


def rate4(k: str, n: str) -> str:
    return f"CASE WHEN ({n}) = 0 THEN 0.0 ELSE round_even(({k})::DOUBLE / ({n}), 4) END"


def mean2(x: str) -> str:
    return f"round_even(avg({x}), 2)"


# Scores are missing exactly when a mate is known, so the loss needs both scores.
CLASSIFIED = """
SELECT evaluation_id, move_id, eval_before_cp, eval_after_cp, mate_before, mate_after, best_move_uci, centipawn_loss,
  CASE WHEN mate_before IS NOT NULL OR mate_after IS NOT NULL THEN
         CASE WHEN (coalesce(mate_before, 0) = 0 AND mate_after < 0)
                OR (mate_before > 0 AND (mate_after IS NULL OR mate_after <= 0))
                OR (mate_before < 0 AND mate_after < 0 AND mate_after > mate_before)
              THEN 'mate_missed' ELSE 'mate_position' END
       WHEN centipawn_loss IS NULL THEN 'unknown' WHEN centipawn_loss <= 20 THEN 'best'
       WHEN centipawn_loss <= 80 THEN 'good' WHEN centipawn_loss <= 150 THEN 'inaccuracy'
       WHEN centipawn_loss <= 300 THEN 'mistake' ELSE 'blunder' END AS classification
FROM (SELECT *, CASE WHEN mate_before IS NULL AND mate_after IS NULL AND eval_before_cp IS NOT NULL
        AND eval_after_cp IS NOT NULL THEN greatest(eval_before_cp - eval_after_cp, 0) END AS centipawn_loss
      FROM raw_evaluations) e"""

SIDES = """
SELECT g.game_id, g.run_id, g.result, g.termination_reason, s.color, s.participant_id,
  CASE WHEN result = '*' THEN 'unfinished' WHEN result = '1/2-1/2' THEN 'draw'
       WHEN (result = '1-0' AND s.color = 'white') OR (result = '0-1' AND s.color = 'black') THEN 'win'
       WHEN result IN ('1-0', '0-1') THEN 'loss' ELSE 'draw' END AS outcome
FROM games g, (SELECT 'white' AS color UNION ALL SELECT 'black') c,
     LATERAL (SELECT c.color, CASE WHEN c.color = 'white' THEN g.white_participant_id ELSE g.black_participant_id END AS participant_id) s
WHERE s.participant_id IN (SELECT participant_id FROM participants)"""

_SUMMARY = f"""
SELECT participant_id * 2 + (color = 'black')::INT AS summary_id, run_id, participant_id, model_snapshot_id, color, mode,
  legality_mode, opening_suite_id, games_played, wins, draws, losses, unfinished,
  plies::DOUBLE / games_played AS avg_game_plies,
  cpl_sum::DOUBLE / nullif(cpl_n, 0) AS avg_cpl, evaluated AS evaluated_move_count,
  {rate('accurate', 'evaluated')} AS accuracy_rate, blunders, mistakes, inaccuracies, attempts AS attempt_count,
  illegal AS illegal_attempts, malformed AS malformed_attempts,
  {rate('illegal', 'attempts')} AS illegal_rate, {low('illegal', 'attempts')} AS illegal_rate_ci_low,
  {high('illegal', 'attempts')} AS illegal_rate_ci_high,
  {rate('malformed', 'attempts')} AS malformed_rate, {low('malformed', 'attempts')} AS malformed_rate_ci_low,
  {high('malformed', 'attempts')} AS malformed_rate_ci_high,
  {rate('wins', 'games_played')} AS win_rate, {low('wins', 'games_played')} AS win_rate_ci_low,
  {high('wins', 'games_played')} AS win_rate_ci_high,
  games_played < 10 AS low_sample, {rate('retries', 'move_n')} AS avg_retries, forfeit_invalid_count,
  {rate('latency', 'move_n')} AS avg_latency_ms, tokens AS total_tokens
FROM (
  SELECT a.*, p.run_id, p.model_snapshot_id, coalesce(pr.mode, 'strict') AS mode,
    coalesce(pr.legality_mode, 'open') AS legality_mode, r.opening_suite_id,
    coalesce(m.move_n, 0) AS move_n, coalesce(m.retries, 0) AS retries, coalesce(m.latency, 0) AS latency,
    coalesce(m.evaluated, 0) AS evaluated, coalesce(m.accurate, 0) AS accurate, coalesce(m.cpl_sum, 0) AS cpl_sum,
    coalesce(m.cpl_n, 0) AS cpl_n, coalesce(m.blunders, 0) AS blunders, coalesce(m.mistakes, 0) AS mistakes,
    coalesce(m.inaccuracies, 0) AS inaccuracies, coalesce(t.attempts, 0) AS attempts, coalesce(t.illegal, 0) AS illegal,
    coalesce(t.malformed, 0) AS malformed, coalesce(t.tokens, 0) AS tokens
  FROM (SELECT s.participant_id, s.color, min(s.run_id) AS first_run, count(*) AS games_played,
          count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'draw') AS draws,
          count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'unfinished') AS unfinished,
          count(*) FILTER (outcome = 'loss' AND termination_reason = 'forfeit_invalid') AS forfeit_invalid_count,
          CAST(coalesce(sum(n.plies), 0) AS BIGINT) AS plies
        FROM sides s LEFT JOIN (SELECT game_id, count(*) AS plies FROM moves GROUP BY 1) n USING (game_id)
        GROUP BY 1, 2) a
  JOIN participants p USING (participant_id)
  JOIN runs r ON r.run_id = a.first_run LEFT JOIN prompts pr USING (prompt_id)
  LEFT JOIN (SELECT s.participant_id, s.color, count(*) AS move_n, CAST(sum(retries_used) AS BIGINT) AS retries,
               sum(latency_total_ms) AS latency, count(e.move_id) AS evaluated,
               count(*) FILTER (classification IN ('best', 'good')) AS accurate,
               CAST(sum(centipawn_loss) AS BIGINT) AS cpl_sum, count(centipawn_loss) AS cpl_n,
               count(*) FILTER (classification = 'blunder') AS blunders,
               count(*) FILTER (classification = 'mistake') AS mistakes,
               count(*) FILTER (classification = 'inaccuracy') AS inaccuracies
             FROM sides s JOIN moves m ON m.game_id = s.game_id AND m.color = s.color
             LEFT JOIN evaluations e USING (move_id) GROUP BY 1, 2) m USING (participant_id, color)
  LEFT JOIN (SELECT s.participant_id, s.color, count(*) AS attempts,
               count(*) FILTER (NOT parse_ok) AS malformed, count(*) FILTER (parse_ok AND NOT legal_ok) AS illegal,
               CAST(sum(u.total_tokens) AS BIGINT) AS tokens
             FROM sides s JOIN attempts x ON x.game_id = s.game_id AND (x.ply % 2 = 1) = (s.color = 'white')
             LEFT JOIN token_usage u USING (attempt_id) GROUP BY 1, 2) t USING (participant_id, color)
) q"""

SUMMARY_VIEWS = ["games", "participants", "runs", "prompts", "snapshots", "moves", "raw_evaluations", "attempts", "token_usage"]


def summary_sql(body: str, extra: dict[str, str] | None = None) -> str:
    parts = {"evaluations": CLASSIFIED, "sides": SIDES, "summary": _SUMMARY, **(extra or {})}
    return with_views(SUMMARY_VIEWS, body, extra=parts)


def judged_sql(views: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """Projections with classified evaluations."""
    return with_views([*views, "raw_evaluations"], body, extra={"evaluations": CLASSIFIED, **(extra or {})})


# The rollup shared by run and model comparison.
ROLLUP = f"""
  CAST(sum(games_played) AS BIGINT) AS games_played, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(draws) AS BIGINT) AS draws,
  CAST(sum(losses) AS BIGINT) AS losses, CAST(sum(unfinished) AS BIGINT) AS unfinished,
  CAST(sum(evaluated_move_count) AS BIGINT) AS evaluated_move_count, CAST(sum(attempt_count) AS BIGINT) AS attempt_count,
  CAST(sum(illegal_attempts) AS BIGINT) AS illegal_attempts, CAST(sum(malformed_attempts) AS BIGINT) AS malformed_attempts,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  round(sum(avg_cpl * games_played) / sum(games_played) FILTER (avg_cpl IS NOT NULL), 6) AS avg_cpl,
  round({rate('sum(accuracy_rate * evaluated_move_count)', 'sum(evaluated_move_count)')}, 6) AS accuracy_rate,
  round({rate('sum(illegal_rate * attempt_count)', 'sum(attempt_count)')}, 6) AS illegal_rate,
  round({rate('sum(malformed_rate * attempt_count)', 'sum(attempt_count)')}, 6) AS malformed_rate,
  round({rate('sum(avg_game_plies * games_played)', 'sum(games_played)')}, 6) AS avg_game_plies,
  round({rate('sum(avg_retries * games_played)', 'sum(games_played)')}, 6) AS avg_retries,
  round({rate('sum(avg_latency_ms * games_played)', 'sum(games_played)')} + 1e-9, 6) AS avg_latency_ms,
  round({rate('sum(wins)', 'sum(games_played)')}, 6) AS win_rate,
  round({low('sum(wins)', 'sum(games_played)')}, 6) AS win_rate_ci_low,
  round({high('sum(wins)', 'sum(games_played)')}, 6) AS win_rate_ci_high,
  round({low('sum(illegal_attempts)', 'sum(attempt_count)')}, 6) AS illegal_rate_ci_low,
  round({high('sum(illegal_attempts)', 'sum(attempt_count)')}, 6) AS illegal_rate_ci_high,
  round({low('sum(malformed_attempts)', 'sum(attempt_count)')}, 6) AS malformed_rate_ci_low,
  round({high('sum(malformed_attempts)', 'sum(attempt_count)')}, 6) AS malformed_rate_ci_high,
  sum(games_played) < 10 AS low_sample"""
