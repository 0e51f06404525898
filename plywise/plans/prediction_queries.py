"""Response validation, metrics, rankings, votes, hard cases, reranking and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plywise.functions import labels, responses
from plywise.functions.probability import expected_risk_score, predicted_label, softmax
from plywise.functions.rewards import RewardRule, linear_reward, move_reward, tactical_reward
from plywise.operators import choices
from plywise.operators import evaluation as ops
from plywise.operators.ordering import first_per_key, frequent
from plywise.plans.board_queries import evaluations
from plywise.plans.candidate_queries import COMPARISON_CTES, indexed_choices, labelled, labelled_sql
from plywise.plans.fixtures import Fixtures, with_views
from plywise.plans.registry import query, rounded, written
from plywise.plans.sqltext import judged_sql, mean2, rate, rate4

# Responses --------------------------------------------------------------------------


@query("response_validation", with_views(["attempts"], """
SELECT attempt_id, nullif(regexp_extract(raw_response, '"move":" ?([^" ]+)', 1), '') AS move, raw_response LIKE '%"move"%' AS parse_ok,
  CASE WHEN raw_response NOT LIKE '%"move"%' THEN 'malformed_json' END AS error_type,
  CASE WHEN raw_response NOT LIKE '%"move"%' THEN 'Response does not contain JSON' END AS reason,
  nullif(trim(regexp_extract(raw_response, '"rationale":"([^"]*)"', 1)), '') AS rationale,
  nullif(regexp_extract(raw_response, '"strategy_update":(.*)}$', 1), '') AS strategy_update FROM attempts"""))
def response_validation(fx: Fixtures) -> DataFrame:
    return responses.validated_moves(fx.attempts.select("attempt_id", "raw_response")).drop("raw_response")


@query("response_validation_of_pages", """
SELECT page_id, false AS parse_ok, CASE WHEN html LIKE '%{%}%' THEN 'Response is not JSON' ELSE 'Response does not contain JSON' END AS reason
FROM pages""")
def response_validation_of_pages(fx: Fixtures) -> DataFrame:
    return responses.validated_moves(fx.pages.select("page_id", "html"), "html").select("page_id", "parse_ok", "reason")


_CRITIC_RAW = """
SELECT *, (coalesce(centipawn_loss, 100) * 7 + seq) % 400 AS said_cpl, seq % 120 AS said_score FROM labelled"""
_CRITIC = """
SELECT *, CASE WHEN said_cpl <= 50 THEN 'good' WHEN said_cpl <= 150 THEN 'playable' WHEN said_cpl <= 300 THEN 'mistake' ELSE 'blunder' END AS said_risk,
  CAST(least(said_score, 100) AS INT) AS said_clamped, seq % 11 <> 0 AND seq % 13 <> 0 AS readable FROM critic_raw"""
CRITIC_CTES = {"critic_raw": _CRITIC_RAW, "critic": _CRITIC}


def critic_answers(fx: Fixtures) -> DataFrame:
    """Labelled candidates with a critic's raw answer, read back into ``predicted``."""
    seq, cpl = F.col("seq"), F.pmod(F.coalesce("centipawn_loss", F.lit(100)) * 7 + F.col("seq"), F.lit(400))
    said = labels.risk(F.lit("unknown"), cpl)
    score = F.pmod(seq, F.lit(120)).cast("string")
    quoted = F.when(F.pmod(seq, F.lit(11)) == 0, F.concat(F.lit('"'), score, F.lit('"'))).otherwise(score)
    answer = F.concat(
        F.lit('My view: {"risk":"'), said, F.lit('","blunder":'), (said == "blunder").cast("string"), F.lit(',"score":'), quoted,
        F.when(F.pmod(seq, F.lit(13)) == 0, "").otherwise(',"reason_type":"unknown"'), F.lit("} end"),
    )
    rows = responses.validated_critics(labelled(fx).withColumn("raw_response", answer))
    target = F.struct("risk", (F.col("risk") == "blunder").alias("blunder"), "score", "reason_type")
    return rows.withColumn("target", target)


@query("critic_responses", labelled_sql("""
SELECT seq, CASE WHEN readable THEN said_risk END AS risk, CASE WHEN readable THEN said_risk = 'blunder' END AS blunder,
  CASE WHEN readable THEN said_clamped END AS score, CASE WHEN readable THEN 'unknown' END AS reason_type FROM critic""", CRITIC_CTES))
def critic_responses(fx: Fixtures) -> DataFrame:
    return critic_answers(fx).select("seq", "predicted.*")


@query("critic_metrics", labelled_sql(f"""
SELECT *, {rate('json_parse_ok', 'examples')} AS json_parse_rate, {rate('risk_match', 'examples')} AS risk_match_rate,
  {rate('blunder_match', 'examples')} AS blunder_match_rate, {rate('exact_target_match', 'examples')} AS exact_target_match_rate FROM (
  SELECT count(*) AS examples, count(*) FILTER (readable) AS json_parse_ok, count(*) FILTER (readable AND said_risk = risk) AS risk_match,
    count(*) FILTER (readable AND (said_risk = 'blunder') = (risk = 'blunder')) AS blunder_match,
    count(*) FILTER (readable AND said_risk = risk AND said_clamped = score AND reason_type = 'unknown') AS exact_target_match,
    avg(abs(said_clamped - score)) FILTER (readable) AS mean_score_abs_error FROM critic) x""", CRITIC_CTES))
def critic_metrics(fx: Fixtures) -> DataFrame:
    return ops.critic_metrics(ops.compare_critic(critic_answers(fx)))


def _risk_rank(c: str) -> str:
    return f"CASE {c} WHEN 'blunder' THEN 0 WHEN 'mistake' THEN 1 WHEN 'playable' THEN 2 ELSE 3 END"


@query("critic_ranking", labelled_sql(f"""
SELECT count(*) AS positions, {mean2('s.cpl')} AS selected_mean_centipawn_loss, {mean2('o.cpl')} AS oracle_mean_centipawn_loss,
  count(*) FILTER (s.said = 'blunder') AS selected_blunders, count(*) FILTER (o.truth = 'blunder') AS oracle_blunders,
  count(*) FILTER (s.uci = o.uci) AS oracle_match_by_move
FROM (SELECT fen_before, arg_max(r, (said_clamped, {_risk_rank('said_risk')}, -seq)) FILTER (readable) AS s,
        arg_max(r, (score, {_risk_rank('risk')}, -seq)) AS o
      FROM (SELECT *, {{'uci': candidate_uci, 'cpl': centipawn_loss, 'said': said_risk, 'truth': risk}} AS r FROM critic) c GROUP BY 1) p
WHERE s IS NOT NULL""", CRITIC_CTES))
def critic_ranking(fx: Fixtures) -> DataFrame:
    return ops.critic_ranking(critic_answers(fx))


_LOGPROBS = {"blunder": (13, 4), "mistake": (7, 3), "playable": (11, 5), "good": (17, 6)}
_PROB = "SELECT *, " + ", ".join(f"-(seq % {m} + 1) / {d}.0::DOUBLE AS lp_{k}" for k, (m, d) in _LOGPROBS.items()) + " FROM labelled"
_TOP = "greatest(lp_blunder, lp_mistake, lp_playable, lp_good)"
_PROB2 = ("SELECT *, CASE " + " ".join(f"WHEN lp_{k} = {_TOP} THEN '{k}'" for k in _LOGPROBS) + " END AS predicted_risk, (0.0 + "
          + " + ".join(f"exp(lp_{k} - {_TOP})" for k in _LOGPROBS) + ") AS z FROM prob1")
_PROB3 = ("SELECT *, " + ", ".join(f"exp(lp_{k} - {_TOP}) / z AS p_{k}" for k in _LOGPROBS) + " FROM prob2")
_PROB4 = "SELECT *, 0.0 + p_blunder * 0.0 + p_mistake * 1.0 + p_playable * 2.0 + p_good * 3.0 AS expected_risk_score FROM prob3"
PROB_CTES = {"prob1": _PROB, "prob2": _PROB2, "prob3": _PROB3, "prob": _PROB4}


def risk_probabilities(fx: Fixtures) -> DataFrame:
    """Candidates with stored log-probabilities turned into label, probabilities and score."""
    lp = {k: -(F.pmod("seq", F.lit(m)) + 1) / F.lit(float(d)) for k, (m, d) in _LOGPROBS.items()}
    stored = labelled(fx).withColumns({f"lp_{k}": v for k, v in lp.items()})
    columns = {k: F.col(f"lp_{k}") for k in _LOGPROBS}
    probs = stored.withColumns({f"p_{k}": v for k, v in softmax(columns).items()})
    return probs.withColumns({
        "predicted_risk": predicted_label(columns),
        "expected_risk_score": expected_risk_score({k: F.col(f"p_{k}") for k in _LOGPROBS}),
        "target": F.struct("risk", (F.col("risk") == "blunder").alias("blunder"), "score", "reason_type"),
    })


@query("risk_probabilities", labelled_sql("""
SELECT seq, predicted_risk, round(p_blunder, 8) AS p_blunder, round(p_good, 8) AS p_good, round(expected_risk_score, 8) AS expected_risk_score,
  expected_risk_score < 1.0 AS vetoed FROM prob""", PROB_CTES))
def risk_probability_rows(fx: Fixtures) -> DataFrame:
    df = risk_probabilities(fx).select("seq", "predicted_risk", "p_blunder", "p_good", "expected_risk_score",
                                       (F.col("expected_risk_score") < 1.0).alias("vetoed"))
    return rounded(df, 8)


@query("risk_label_metrics", labelled_sql(f"""
SELECT *, {rate('risk_match', 'examples')} AS risk_match_rate, {rate('blunder_match', 'examples')} AS blunder_match_rate FROM (
  SELECT count(*) AS examples, count(*) FILTER (predicted_risk = risk) AS risk_match,
    count(*) FILTER ((predicted_risk = 'blunder') = (risk = 'blunder')) AS blunder_match FROM prob) x""", PROB_CTES))
def risk_label_metrics(fx: Fixtures) -> DataFrame:
    return ops.risk_label_metrics(risk_probabilities(fx))


@query("probability_ranking", labelled_sql(f"""
SELECT count(*) AS positions, {mean2('s.cpl')} AS selected_mean_centipawn_loss, {mean2('o.cpl')} AS oracle_mean_centipawn_loss,
  {mean2('f.cpl')} AS first_generator_mean_centipawn_loss, count(*) FILTER (s.truth = 'blunder') AS selected_blunders,
  count(*) FILTER (o.truth = 'blunder') AS oracle_blunders, count(*) FILTER (f.truth = 'blunder') AS first_generator_blunders,
  count(*) FILTER (s.uci = o.uci) AS oracle_match_by_move, count(*) FILTER (s.cpl < f.cpl) AS improved_vs_first_count,
  count(*) FILTER (s.cpl > f.cpl) AS worsened_vs_first_count, count(*) FILTER (s.cpl = f.cpl) AS tied_first_count
FROM (SELECT fen_before, arg_max(r, (expected_risk_score, -rank, -seq)) AS s,
        arg_max(r, (score, {_risk_rank('risk')}, coalesce(-centipawn_loss, -999999), -seq)) AS o, arg_min(r, (rank, seq)) AS f
      FROM (SELECT *, coalesce(candidate_rank_in_generator, 999999) AS rank, {{'uci': candidate_uci, 'cpl': centipawn_loss, 'truth': risk}} AS r
            FROM prob) c GROUP BY 1) p""", PROB_CTES))
def probability_ranking(fx: Fixtures) -> DataFrame:
    return ops.probability_ranking(risk_probabilities(fx))


@query("listed_candidates", with_views(["moves", "legal_moves"], """
SELECT move_id, CAST(min(pos) AS INT) AS first_index, uci, CASE WHEN min(pos) = 0 THEN 'idea ' || any_value(accepted_san) END AS idea
FROM (SELECT move_id, fen_before, accepted_san, 0 AS pos, accepted_uci AS uci FROM moves
      UNION ALL SELECT move_id, fen_before, accepted_san, 2, accepted_uci || '0' FROM moves
      UNION ALL SELECT move_id, fen_before, accepted_san, 3, accepted_uci FROM moves) x
WHERE (fen_before, uci) IN (SELECT (fen, uci) FROM legal_moves) GROUP BY move_id, uci"""))
def listed_candidates(fx: Fixtures) -> DataFrame:
    raw = F.concat(
        F.lit('Here: {"candidates":[{"move":" '), F.upper("accepted_uci"), F.lit('","idea":"idea '), F.col("accepted_san"),
        F.lit('"},{"move":7},{"move":"'), F.col("accepted_uci"), F.lit('0","idea":3},{"move":"'), F.col("accepted_uci"), F.lit('"}]}'))
    rows = responses.listed_candidates(fx.moves.select("move_id", "fen_before", raw.alias("raw_response")))
    items = rows.select("move_id", "fen_before", F.inline("items")).withColumnRenamed("move", "uci")
    legal = ops.with_legality(items, fx.legal_moves, "fen_before", "uci").where("legal_ok")
    first = first_per_key(legal.select("move_id", "uci", "idea", "pos"), ["move_id", "uci"], ["pos"])
    return first.select("move_id", F.col("pos").alias("first_index"), "uci", "idea")


@query("pair_decisions", with_views(["attempts", "moves"], """
SELECT attempt_id, CASE WHEN a.parsed_move = accepted_uci THEN accepted_uci ELSE 'left' END AS selected_uci, a.parsed_move, a.parse_ok,
  coalesce(a.parsed_move = accepted_uci, false) AS candidate_ok,
  CASE WHEN a.parsed_move = accepted_uci THEN NULL WHEN a.parse_ok THEN 'parsed_move_not_pair_candidate' ELSE 'malformed_json' END AS fallback_reason
FROM attempts a JOIN moves m USING (game_id, ply)"""))
def pair_decisions(fx: Fixtures) -> DataFrame:
    rows = fx.attempts.select("attempt_id", "game_id", "ply", "raw_response").join(
        fx.moves.select("game_id", "ply", F.col("accepted_uci").alias("right")), ["game_id", "ply"]).withColumn("left", F.lit("left"))
    return responses.pair_decisions(rows, "left", "right").select(
        "attempt_id", "selected_uci", "parsed_move", "parse_ok", "candidate_ok", "fallback_reason")


@query("critic_summaries", with_views(["moves"], """
SELECT move_id, CASE WHEN ply % 3 <> 0 THEN accepted_uci END AS best_reply, CASE WHEN ply % 2 = 0 THEN 'high' ELSE 'unknown' END AS risk,
  CASE WHEN ply % 4 < 2 THEN ply % 2 = 0 END AS blunder_suspected, CASE WHEN ply % 3 <> 0 THEN 'because ' || accepted_san END AS critic_reason FROM moves"""))
def critic_summaries(fx: Fixtures) -> DataFrame:
    ply = F.col("ply")
    raw = F.concat(
        F.lit('{"best_reply":'), F.when(ply % 3 != 0, F.concat(F.lit('" '), F.upper("accepted_uci"), F.lit('"'))).otherwise("null"),
        F.lit(',"risk":'), F.when(ply % 2 == 0, '"high"').otherwise("2"), F.lit(',"blunder_suspected":'),
        F.when(ply % 4 < 2, (ply % 2 == 0).cast("string")).otherwise('"maybe"'),
        F.when(ply % 3 != 0, F.concat(F.lit(',"reason":"because '), F.col("accepted_san"), F.lit('"'))).otherwise(""), F.lit("}"))
    return responses.critic_summaries(fx.moves.select("move_id", raw.alias("raw_response"))).drop("raw_response")


# Prediction metrics -----------------------------------------------------------------

_PREDICTIONS = """
SELECT a.attempt_id, a.game_id, a.ply, m.move_id, m.fen_before AS fen, m.accepted_uci AS target_move, a.parsed_move, a.parse_ok,
  a.parse_ok AND l.uci IS NOT NULL AS legal_ok, coalesce(a.parsed_move = m.accepted_uci, false) AS top1_match, m.l_linestatus = 'F' AND m.ply = 7 AS service_error,
  CASE WHEN a.parse_ok AND l.uci IS NOT NULL THEN e.centipawn_loss END AS centipawn_loss,
  CASE WHEN NOT a.parse_ok THEN 'malformed' WHEN l.uci IS NULL THEN 'illegal' ELSE coalesce(e.classification, 'unknown') END AS classification, e.best_move_uci
FROM attempts a JOIN moves m USING (game_id, ply) LEFT JOIN legal_moves l ON l.fen = m.fen_before AND l.uci = a.parsed_move
LEFT JOIN evaluations e ON e.move_id = m.move_id"""
_PREDICTION_VIEWS = ["attempts", "moves", "legal_moves"]


def checked_predictions(fx: Fixtures) -> DataFrame:
    """All attempts as predictions of the accepted move, with legality."""
    first = fx.attempts.select("attempt_id", "game_id", "ply", "parsed_move", "parse_ok")
    moves = fx.moves.select("move_id", "game_id", "ply", F.col("fen_before").alias("fen"), F.col("accepted_uci").alias("target_move"),
                            ((F.col("l_linestatus") == "F") & (F.col("ply") == 7)).alias("service_error"))
    rows = ops.with_legality(first.join(moves, ["game_id", "ply"]), fx.legal_moves).withColumn("legal_ok", F.col("parse_ok") & F.col("legal_ok"))
    return rows.withColumn("top1_match", F.coalesce(F.col("parsed_move") == F.col("target_move"), F.lit(False)))


def predictions(fx: Fixtures) -> DataFrame:
    """Checked predictions with engine labels."""
    fx.number_lines()
    judged = checked_predictions(fx).join(evaluations(fx).select("move_id", "centipawn_loss", "classification", "best_move_uci"), "move_id", "left")
    return judged.withColumns({
        "centipawn_loss": F.when(F.col("legal_ok"), F.col("centipawn_loss")),
        "classification": F.when(~F.col("parse_ok"), "malformed").when(~F.col("legal_ok"), "illegal")
        .otherwise(F.coalesce("classification", F.lit("unknown"))),
    })


def _prediction_sql(body: str, extra: dict[str, str] | None = None) -> str:
    return judged_sql(_PREDICTION_VIEWS, body, {"predictions": _PREDICTIONS, **(extra or {})})


@query("legality_check", _prediction_sql("SELECT attempt_id, legal_ok FROM predictions"))
def legality_check(fx: Fixtures) -> DataFrame:
    return checked_predictions(fx).select("attempt_id", "legal_ok")


@query("prediction_metrics", _prediction_sql(f"""
SELECT *, {rate('json_parse_ok', 'examples')} AS json_parse_rate, {rate('legal_move_ok', 'examples')} AS legal_move_rate,
  {rate('top1_match', 'examples')} AS top1_match_rate FROM (
  SELECT count(*) AS examples, count(*) FILTER (parse_ok) AS json_parse_ok, count(*) FILTER (legal_ok) AS legal_move_ok,
    count(*) FILTER (top1_match) AS top1_match, count(*) FILTER (service_error) AS service_errors FROM predictions) x"""))
def prediction_metrics(fx: Fixtures) -> DataFrame:
    return ops.prediction_metrics(checked_predictions(fx))


def _reward_sql(mode: str) -> str:
    lerp = lambda x0, x1, y0, y1: f"WHEN c <= {x1} THEN {y0}::DOUBLE + (c - {x0}) / {float(x1 - x0)}::DOUBLE * {y1 - y0}::DOUBLE "
    tactical = "CASE WHEN c <= 20 THEN 1.0 " + lerp(20, 80, 1.0, 0.6) + lerp(80, 150, 0.6, 0.1) + lerp(150, 300, 0.1, -0.8) + "ELSE -1.0 END"
    curve = tactical if mode == "tactical" else "1.0 - least(c, 300) / 300.0::DOUBLE"
    mate = "WHEN classification = 'mate_missed' THEN -1.0" if mode == "tactical" else ""
    return (f"CASE WHEN NOT parse_ok THEN -1.0 WHEN NOT legal_ok THEN {-1.0 if mode == 'tactical' else -0.5} "
            f"WHEN c IS NULL THEN CASE WHEN parsed_move = best_move_uci THEN 1.0 {mate} ELSE 0.0 END ELSE {curve} END")


_REWARDED = f"SELECT *, {_reward_sql('linear')} AS reward, {_reward_sql('tactical')} AS tactical FROM (SELECT *, centipawn_loss AS c FROM predictions) x"


def _reward(rule: RewardRule):
    return move_reward(*[F.col(c) for c in ("parse_ok", "legal_ok", "centipawn_loss", "classification", "parsed_move", "best_move_uci")], rule=rule)


@query("move_rewards", _prediction_sql("SELECT attempt_id, round(reward, 6) AS linear, round(tactical, 6) AS tactical FROM rewarded", {"rewarded": _REWARDED}))
def move_rewards(fx: Fixtures) -> DataFrame:
    return rounded(predictions(fx).select("attempt_id", _reward(RewardRule()).alias("linear"), _reward(RewardRule("tactical")).alias("tactical")))


@query("reward_curves", with_views(["candidates"], """
SELECT seq, round(1.0 - least(c, 300) / 300.0, 6) AS linear, round(CASE WHEN c <= 20 THEN 1.0 WHEN c <= 80 THEN 1.0 - (c - 20) / 60.0 * 0.4
  WHEN c <= 150 THEN 0.6 - (c - 80) / 70.0 * 0.5 WHEN c <= 300 THEN 0.1 - (c - 150) / 150.0 * 0.9 ELSE -1.0 END, 6) AS tactical
FROM (SELECT seq, centipawn_loss::DOUBLE AS c FROM candidates WHERE centipawn_loss IS NOT NULL) x"""))
def reward_curves(fx: Fixtures) -> DataFrame:
    known = fx.candidates.where("centipawn_loss IS NOT NULL")
    return rounded(known.select("seq", linear_reward(F.col("centipawn_loss")).alias("linear"), tactical_reward(F.col("centipawn_loss")).alias("tactical")))


@query("loss_metrics", _prediction_sql(f"""
SELECT *, {rate('json_parse_ok', 'examples')} AS json_parse_rate, {rate('legal_move_ok', 'examples')} AS legal_move_rate,
  {rate('top1_match', 'examples')} AS top1_match_rate, {rate('blunders', 'examples')} AS blunder_rate, {rate('mistakes', 'examples')} AS mistake_rate,
  {rate('inaccuracies', 'examples')} AS inaccuracy_rate FROM (
  SELECT count(*) AS examples, count(*) FILTER (parse_ok) AS json_parse_ok, count(*) FILTER (legal_ok) AS legal_move_ok,
    count(*) FILTER (top1_match) AS top1_match, count(*) FILTER (NOT parse_ok) AS malformed, count(*) FILTER (parse_ok AND NOT legal_ok) AS illegal,
    count(*) FILTER (classification = 'blunder') AS blunders, count(*) FILTER (classification = 'mistake') AS mistakes,
    count(*) FILTER (classification = 'inaccuracy') AS inaccuracies, round(avg(reward), 6) AS mean_reward,
    round(avg(centipawn_loss), 6) AS mean_generated_cpl, count(centipawn_loss) AS cpl_scored_legal_moves FROM rewarded) x""", {"rewarded": _REWARDED}))
def loss_metrics(fx: Fixtures) -> DataFrame:
    df = ops.loss_metrics(predictions(fx).withColumn("reward", _reward(RewardRule())))
    return df.withColumns({c: F.round(c, 6) for c in ("mean_reward", "mean_generated_cpl")})


# Rewards with reuse -----------------------------------------------------------------

_ENGINE = """
SELECT fen_before AS fen, candidate_uci AS uci, centipawn_loss, classification, best_move_uci, source FROM (
  SELECT *, row_number() OVER (PARTITION BY fen_before, candidate_uci ORDER BY seq) AS nth FROM candidates) x WHERE nth = 1"""
_BEST_KNOWN = "SELECT fen, min(best_move_uci) AS best FROM engine WHERE source = 'arena_move' GROUP BY 1"
_SAMPLES = f"""
SELECT p.*, CASE WHEN known THEN k.centipawn_loss WHEN is_best THEN 0 WHEN legal_ok THEN k.centipawn_loss END AS c0,
  CASE WHEN NOT parse_ok THEN 'malformed' WHEN NOT legal_ok THEN 'illegal' WHEN known THEN k.classification WHEN is_best THEN 'best' ELSE k.classification END AS class0,
  CASE WHEN known THEN k.best_move_uci WHEN is_best THEN best WHEN legal_ok THEN k.best_move_uci END AS best0
FROM (SELECT q.batch, q.attempt_id, q.fen, q.parsed_move, q.parse_ok, q.legal_ok, b.best, q.legal_ok AND coalesce(e.source <> 'random_legal', false) AS known,
        q.legal_ok AND NOT coalesce(e.source <> 'random_legal', false) AND coalesce(b.best = q.parsed_move, false) AS is_best
      FROM (SELECT *, game_id % 64 AS batch FROM predictions) q LEFT JOIN engine e ON e.fen = q.fen AND e.uci = q.parsed_move LEFT JOIN best_known b ON b.fen = q.fen) p
LEFT JOIN engine k ON k.fen = p.fen AND k.uci = p.parsed_move"""
_SCORED = f"SELECT *, CASE WHEN is_best THEN 1.0 ELSE {_reward_sql('linear')} END AS reward FROM (SELECT batch, attempt_id, fen, parsed_move, parse_ok, legal_ok, known, is_best, c0 AS c, class0 AS classification, best0 AS best_move_uci FROM samples) x"
_REUSE_CTES = {"engine": _ENGINE, "best_known": _BEST_KNOWN, "samples": _SAMPLES, "scored": _SCORED}


def reward_samples(fx: Fixtures) -> DataFrame:
    """Predictions scored with a partly filled evaluation store, in 64 batches."""
    engine = first_per_key(
        fx.candidates.select(F.col("fen_before").alias("fen"), F.col("candidate_uci").alias("uci"), "centipawn_loss", "classification",
                             "best_move_uci", "source", "seq"), ["fen", "uci"], ["seq"])
    # Look-ups leave out moves that are NULL; read apart, these keep the best moves on the look-ups' exchange.
    known = engine.where("uci IS NOT NULL").unionByName(engine.where("uci IS NULL"))
    best = known.where("source = 'arena_move'").groupBy("fen").agg(F.min("best_move_uci").alias("best"))
    first = fx.attempts.select("attempt_id", "game_id", "ply", "parsed_move", "parse_ok")
    moves = fx.moves.select("game_id", "ply", F.col("fen_before").alias("fen"))
    rows = first.join(moves, ["game_id", "ply"]).select(
        F.pmod("game_id", F.lit(64)).alias("batch"), F.col("attempt_id").alias("idx"), "fen", "parsed_move", "parse_ok")
    rows = written(fx, rows, "proposals")
    counts = frequent(rows, ["fen", "parsed_move"])
    checked = ops.with_legality(rows, fx.legal_moves, counts=counts).withColumn("legal_ok", F.col("parse_ok") & F.col("legal_ok"))
    return ops.reward_samples(checked, engine.where("source <> 'random_legal'"), best, engine, counts=counts)


def _reuse_sql(body: str) -> str:
    return judged_sql([*_PREDICTION_VIEWS, "candidates"], body, {"predictions": _PREDICTIONS, **_REUSE_CTES})


@query("reward_samples", _reuse_sql("""
SELECT attempt_id AS idx, classification, c AS centipawn_loss, round(reward, 6) AS reward, known OR is_best AS cache_hit,
  legal_ok AND NOT known AND NOT is_best AS evaluated FROM scored"""))
def reward_sample_rows(fx: Fixtures) -> DataFrame:
    return rounded(reward_samples(fx).select("idx", "classification", "centipawn_loss", "reward", "cache_hit", "evaluated"))


@query("reward_batches", _reuse_sql(f"""
SELECT *, {rate('malformed', 'examples')} AS malformed_fraction, {rate('illegal', 'examples')} AS illegal_fraction, {rate('legal', 'examples')} AS legal_fraction FROM (
  SELECT batch, count(*) AS examples, count(*) FILTER (NOT parse_ok) AS malformed, count(*) FILTER (parse_ok AND NOT legal_ok) AS illegal,
    count(*) FILTER (legal_ok) AS legal, round(avg(reward), 6) AS mean_reward, round(avg(c) FILTER (legal_ok), 6) AS mean_legal_cpl,
    count(*) FILTER (legal_ok AND NOT known AND NOT is_best) AS engine_evaluations, count(*) FILTER (known OR is_best) AS cache_hits
  FROM scored GROUP BY batch) x"""))
def reward_batches(fx: Fixtures) -> DataFrame:
    df = ops.reward_batches(reward_samples(fx))
    return df.withColumns({c: F.round(c, 6) for c in ("mean_reward", "mean_legal_cpl")})


_REWARD_LOG = """
SELECT batch, examples, string_agg(attempt_id || ':' || coalesce(parsed_move, '-') || ':' || classification, ',' ORDER BY attempt_id) AS samples
FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY attempt_id) AS nth, count(*) OVER (PARTITION BY batch) AS examples FROM scored) x
WHERE nth <= 5 GROUP BY 1, 2"""


@query("reward_log_heads", _reuse_sql(_REWARD_LOG))
def reward_log_heads(fx: Fixtures) -> DataFrame:
    return log_heads(reward_log(fx))


def reward_log(fx: Fixtures) -> DataFrame:
    """The log of all batches from samples that are scored once and written."""
    samples = written(fx, reward_samples(fx).drop("fen"), "samples")
    named = samples.withColumn("parsed_move", F.concat_ws(":", F.col("idx").cast("string"), F.coalesce("parsed_move", F.lit("-"))))
    return ops.reward_log(named, ops.reward_batches(samples), 5)


def log_heads(log: DataFrame) -> DataFrame:
    schema = "examples BIGINT, samples ARRAY<STRUCT<parsed_move: STRING, classification: STRING>>"
    parsed = log.select("batch", F.from_json("value", schema).alias("r"))
    line = F.transform("r.samples", lambda s: F.concat_ws(":", s["parsed_move"], s["classification"]))
    return parsed.select("batch", "r.examples", F.array_join(line, ",").alias("samples"))


# Choice reports -----------------------------------------------------------------------

_JUDGED = """
SELECT *, s.cpl - t.cpl AS regret, s.cpl - f.cpl AS delta, list_filter([CASE WHEN s IS NULL THEN 'not_candidate' END,
    CASE WHEN s.risk = 'blunder' THEN 'selected_blunder' END, CASE WHEN s.risk IN ('mistake', 'blunder') AND t.risk = 'good' THEN 'missed_good' END,
    CASE WHEN s.cpl - t.cpl >= 200 THEN 'high_regret' END], lambda x: x IS NOT NULL) AS categories,
  CASE WHEN s IS NULL THEN 1000000 WHEN s.cpl IS NULL OR t.cpl IS NULL THEN 0 ELSE (s.risk = 'blunder')::INT * 1000 + s.cpl - t.cpl END AS severity
FROM (SELECT *, cands[list_position(ucis, target_move)] AS t, cands[1] AS f, CASE WHEN picked <= candidate_count THEN cands[picked] END AS s,
        CASE WHEN picked <= candidate_count THEN picked END AS selected_index
      FROM (SELECT *, choice_index % 5 + 1 AS picked, choice_index % 9 <> 0 AS parse_ok, choice_index % 4 <> 0 AS legal_ok FROM indexed) a) b"""
_REPORT_CTES = {**COMPARISON_CTES, "judged": _JUDGED}


def judged_choices(fx: Fixtures) -> DataFrame:
    """Choice rows zipped with predictions that name a list position (or no candidate)."""
    rows = indexed_choices(fx).withColumnRenamed("choice_index", "example_index")
    picked = F.try_element_at("candidates.uci", F.pmod("example_index", F.lit(5)).cast("int") + 1)
    preds = rows.select("example_index", F.coalesce(picked, F.lit("zz")).alias("parsed_move"),
                        (F.pmod("example_index", F.lit(9)) != 0).alias("parse_ok"), (F.pmod("example_index", F.lit(4)) != 0).alias("legal_ok"))
    return ops.judged(ops.zip_predictions(rows, preds), "parsed_move")


def _choice_report_sql(source: str, flags: bool) -> str:
    extra = "count(*) FILTER (parse_ok) AS parse_ok, count(*) FILTER (legal_ok) AS legal_ok," if flags else ""
    rates = f", {rate4('parse_ok', 'examples')} AS parse_rate, {rate4('legal_ok', 'examples')} AS legal_rate" if flags else ""
    return f"""
SELECT *, {rate4('candidate_ok', 'examples')} AS candidate_ok_rate, {rate4('top1_match', 'examples')} AS top1_match_rate{rates} FROM (
  SELECT count(*) AS examples, {extra} count(s) AS candidate_ok, count(*) FILTER (s.uci = target_move) AS top1_match,
    {mean2('s.cpl')} AS selected_mean_centipawn_loss, {mean2('t.cpl')} AS target_oracle_mean_centipawn_loss,
    {mean2('f.cpl')} AS first_prompt_candidate_mean_centipawn_loss, count(*) FILTER (s.risk IN ('mistake', 'blunder')) AS selected_high_risk_count,
    {mean2('regret')} AS mean_cpl_regret_vs_oracle, count(*) FILTER (delta < 0) AS improved_vs_first_count,
    count(*) FILTER (delta > 0) AS worsened_vs_first_count, count(*) FILTER (delta = 0) AS tied_first_count FROM {source}) x"""


def _histogram_sql(source: str) -> str:
    return f"""
SELECT 'selected_risk' AS metric, s.risk AS key, count(*) AS n FROM {source} WHERE s IS NOT NULL GROUP BY 2
UNION ALL SELECT 'target_risk', t.risk, count(*) FROM {source} GROUP BY 2
UNION ALL SELECT 'first_prompt_risk', f.risk, count(*) FROM {source} GROUP BY 2
UNION ALL SELECT 'selected_prompt_index', selected_index::VARCHAR, count(*) FROM {source} WHERE s IS NOT NULL GROUP BY 2
UNION ALL SELECT 'target_prompt_index', list_position(ucis, target_move)::VARCHAR, count(*) FROM {source} GROUP BY 2
UNION ALL SELECT 'risk_transition', t.risk || '->' || s.risk, count(*) FROM {source} WHERE s IS NOT NULL GROUP BY 2
UNION ALL SELECT 'hard_case', category, count(*) FROM (SELECT unnest(categories) AS category FROM {source}) h GROUP BY 2"""


@query("choice_report", labelled_sql(_choice_report_sql("judged", True), _REPORT_CTES))
def choice_report(fx: Fixtures) -> DataFrame:
    return ops.choice_report(judged_choices(fx), "parsed_move")


@query("choice_report_counts", labelled_sql(_histogram_sql("judged"), _REPORT_CTES))
def choice_report_counts(fx: Fixtures) -> DataFrame:
    return ops.choice_report_counts(judged_choices(fx))


@query("choice_hard_cases", labelled_sql("""
SELECT choice_index AS example_index, CAST(severity AS INT) AS severity, array_to_string(categories, ',') AS categories, CAST(regret AS INT) AS regret
FROM judged WHERE len(categories) > 0 ORDER BY severity DESC, choice_index LIMIT 50""", _REPORT_CTES))
def choice_hard_cases(fx: Fixtures) -> DataFrame:
    judged = judged_choices(fx).select("example_index", "severity", "categories", "regret")
    return ops.hard_cases(judged, 50).select("example_index", "severity", F.array_join("categories", ",").alias("categories"), "regret")


@query("hard_case_variants", labelled_sql("""
SELECT choice_index AS example_index, CAST(v AS INT) AS variant, target_move, CAST(list_position(shown, target_move) AS INT) AS target_prompt_index,
  array_to_string(shown, ',') AS shown, 'hardcase_eval' AS split
FROM (SELECT choice_index, v, target_move, CASE WHEN v = 0 THEN ucis
        ELSE [x.u FOR x IN list_sort([{'h': sha256('5|' || choice_index || '|' || fen || '|' || v || '|' || u), 'u': u} FOR u IN ucis])] END AS shown
      FROM judged, (SELECT unnest(range(3)) AS v) n WHERE len(categories) > 0) x""", _REPORT_CTES))
def hard_case_variants(fx: Fixtures) -> DataFrame:
    cases = judged_choices(fx).where(F.size("categories") > 0).select(
        "example_index", "categories", "fen", "side_to_move", F.col("parsed_move").alias("predicted_move"), "target", "candidates",
        F.col("regret").alias("cpl_regret_vs_oracle"), F.col("delta_first").alias("cpl_delta_vs_first"))
    return choices.hard_case_variants(cases, variants=3, seed=5, with_prompt=False).select(
        F.col("hard_case_example_index").alias("example_index"), F.col("hard_case_variant_index").alias("variant"), "target_move",
        "target_prompt_index", F.array_join("candidates.uci", ",").alias("shown"), "split")


@query("hard_case_counts", labelled_sql("""
SELECT 'input_hard_cases' AS metric, '' AS key, count(*) AS n FROM cases
UNION ALL SELECT 'rows_written', '', count(*) * 3 FROM cases
UNION ALL SELECT 'dropped_too_few_candidates', '', 0
UNION ALL SELECT 'dropped_missing_target', '', 0
UNION ALL SELECT 'by_category', category, count(*) FROM (SELECT unnest(categories) AS category FROM cases) c GROUP BY 2
UNION ALL SELECT 'by_target_risk', target_risk, count(*) FROM cases GROUP BY 2""",
    {**_REPORT_CTES, "cases": "SELECT * FROM judged WHERE len(categories) > 0"}))
def hard_case_counts(fx: Fixtures) -> DataFrame:
    return choices.hard_case_counts(judged_choices(fx).where(F.size("categories") > 0), variants=3)


# Votes --------------------------------------------------------------------------------

_PAIR_PREDS = """
SELECT *, CASE (choice_index + pair_index) % 4 WHEN 0 THEN l.uci WHEN 1 THEN r.uci WHEN 2 THEN CASE WHEN (l.k1, l.k2, l.k3) >= (r.k1, r.k2, r.k3) THEN l.uci ELSE r.uci END
  ELSE 'zz' END AS parsed_move, CASE WHEN (l.k1, l.k2, l.k3) >= (r.k1, r.k2, r.k3) THEN l.uci ELSE r.uci END AS move FROM comparisons"""
_VOTES = """
SELECT choice_index, uci, CAST(sum(vote) AS BIGINT) AS votes FROM (
  SELECT choice_index, l.uci AS uci, (parsed_move = l.uci)::INT AS vote FROM pair_preds UNION ALL
  SELECT choice_index, r.uci, (parsed_move = r.uci)::INT FROM pair_preds) x GROUP BY 1, 2"""
_WINNERS = """
SELECT i.*, arg_max(u.uci, (coalesce(v.votes, 0), -u.pos)) AS vote_winner, max(coalesce(v.votes, 0)) - arg_min(coalesce(v.votes, 0), u.pos) AS margin,
  arg_min(u.uci, u.pos) AS first_uci
FROM indexed i, LATERAL (SELECT unnest(i.ucis) AS uci, generate_subscripts(i.ucis, 1) AS pos) u LEFT JOIN votes v ON v.choice_index = i.choice_index AND v.uci = u.uci
WHERE i.choice_index IN (SELECT choice_index FROM votes) GROUP BY ALL"""
_VOTE_CTES = {**COMPARISON_CTES, "pair_preds": _PAIR_PREDS, "votes": _VOTES, "winners": _WINNERS}
_VOTED = _JUDGED.replace(
    "(SELECT *, choice_index % 5 + 1 AS picked, choice_index % 9 <> 0 AS parse_ok, choice_index % 4 <> 0 AS legal_ok FROM indexed)",
    "(SELECT *, list_position(ucis, vote_winner) AS picked FROM winners)")


def pair_predictions(fx: Fixtures, indexed: DataFrame | None = None) -> DataFrame:
    rows = choices.comparison_rows(indexed_choices(fx) if indexed is None else indexed, with_prompt=False)
    pick = F.pmod(F.col("pair_source_choice_index") + F.col("pair_index"), F.lit(4))
    return rows.withColumns({
        "parsed_move": F.when(pick == 0, F.col("pair_moves")[0]).when(pick == 1, F.col("pair_moves")[1]).when(pick == 2, F.col("move")).otherwise("zz"),
        "parse_ok": pick != 3, "legal_ok": pick != 3,
    })


@query("pair_votes", labelled_sql("SELECT * FROM votes", _VOTE_CTES))
def pair_votes(fx: Fixtures) -> DataFrame:
    return ops.pair_votes(pair_predictions(fx))


@query("pair_metrics", labelled_sql(f"""
SELECT *, {rate4('pair_parse_ok', 'pair_examples')} AS pair_parse_rate, {rate4('pair_legal_ok', 'pair_examples')} AS pair_legal_rate,
  {rate4('pair_candidate_ok', 'pair_examples')} AS pair_candidate_ok_rate, {rate4('pair_top1_match', 'pair_examples')} AS pair_top1_match_rate FROM (
  SELECT count(*) AS pair_examples, count(*) FILTER (parsed_move <> 'zz') AS pair_parse_ok, count(*) FILTER (parsed_move <> 'zz') AS pair_legal_ok,
    count(*) FILTER (parsed_move <> 'zz') AS pair_candidate_ok, count(*) FILTER (parsed_move = move) AS pair_top1_match FROM pair_preds) x""", _VOTE_CTES))
def pair_metrics(fx: Fixtures) -> DataFrame:
    return ops.pair_metrics(pair_predictions(fx))


@query("vote_winners", labelled_sql("""
SELECT choice_index, vote_winner, CAST(margin AS BIGINT) AS vote_margin_to_first, vote_winner <> first_uci AND margin < 2 AS margin_fallback_applied,
  CASE WHEN margin < 2 THEN first_uci ELSE vote_winner END AS selected_move FROM winners""", _VOTE_CTES))
def vote_winners(fx: Fixtures) -> DataFrame:
    rows = indexed_choices(fx)
    return ops.vote_winners(rows, ops.pair_votes(pair_predictions(fx, rows)), min_margin=2)


def voted_choices(fx: Fixtures) -> DataFrame:
    rows = indexed_choices(fx)
    winners = ops.vote_winners(rows, ops.pair_votes(pair_predictions(fx, rows)))
    return ops.judged(rows.join(winners, "choice_index"), "selected_move")


@query("vote_report", labelled_sql(_choice_report_sql("judged", False), {**_VOTE_CTES, "judged": _VOTED}))
def vote_report(fx: Fixtures) -> DataFrame:
    return ops.choice_report(voted_choices(fx), "selected_move", with_flags=False)


@query("vote_report_counts", labelled_sql(_histogram_sql("judged"), {**_VOTE_CTES, "judged": _VOTED}))
def vote_report_counts(fx: Fixtures) -> DataFrame:
    return ops.choice_report_counts(voted_choices(fx))


@query("vote_hard_cases", labelled_sql("""
SELECT choice_index, CAST(severity AS INT) AS severity, array_to_string(categories, ',') AS categories, CAST(regret AS INT) AS regret, tally
FROM judged JOIN (SELECT choice_index, string_agg(uci || '=' || votes, ',' ORDER BY uci) AS tally FROM votes GROUP BY 1) t USING (choice_index)
WHERE len(categories) > 0 ORDER BY severity DESC, choice_index LIMIT 50""", {**_VOTE_CTES, "judged": _VOTED}))
def vote_hard_cases(fx: Fixtures) -> DataFrame:
    rows = indexed_choices(fx)
    votes = written(fx, ops.pair_votes(pair_predictions(fx, rows)), "votes")
    judged = ops.judged(rows.join(ops.vote_winners(rows, votes), "choice_index"), "selected_move")
    cases = ops.hard_cases(judged.select("choice_index", "severity", "categories", "regret"), 50, "choice_index")
    tally = ops.vote_tallies(votes.join(cases.select("choice_index"), "choice_index", "left_semi"))
    return cases.join(tally, "choice_index").select("choice_index", "severity", F.array_join("categories", ",").alias("categories"), "regret", "tally")


@query("runtime_votes", labelled_sql("""
SELECT choice_index, vote_winner, CAST(margin AS BIGINT) AS vote_margin_to_first, vote_winner <> first_uci AND margin < 2 AS margin_fallback_applied,
  CASE WHEN margin < 2 THEN first_uci ELSE vote_winner END AS selected_move, decisions, invalid_count
FROM (SELECT w.choice_index, w.vote_winner, w.margin, w.first_uci, CAST(count(p.choice_index) AS BIGINT) AS decisions,
    CAST(count(*) FILTER (p.parsed_move = 'zz') AS BIGINT) AS invalid_count
  FROM winners w LEFT JOIN pair_preds p USING (choice_index) GROUP BY 1, 2, 3, 4) x
UNION ALL SELECT choice_index, ucis[1], 0, false, ucis[1], 0, 0 FROM single""", {
    **_VOTE_CTES, "single": "SELECT -1 - choice_index AS choice_index, ucis[1:1] AS ucis FROM indexed WHERE choice_index % 6 = 0",
    "votes": """
SELECT choice_index, uci, CAST(sum(vote) AS BIGINT) AS votes FROM (
  SELECT choice_index, l.uci AS uci, (parsed_move IN (l.uci, 'zz'))::INT AS vote FROM pair_preds UNION ALL
  SELECT choice_index, r.uci, (parsed_move = r.uci)::INT FROM pair_preds) x GROUP BY 1, 2"""}))
def runtime_votes(fx: Fixtures) -> DataFrame:
    """All pairs of every choice; some choices are also shown with their first candidate alone."""
    rows = indexed_choices(fx)
    asked = pair_predictions(fx, rows).select(F.col("pair_source_choice_index").alias("choice_index"), "pair_moves", "parsed_move")
    alone = rows.where("choice_index % 6 = 0").select((-1 - F.col("choice_index")).alias("choice_index"), F.slice("candidates", 1, 1).alias("candidates"))
    return ops.runtime_votes(rows.select("choice_index", "candidates").unionByName(alone), asked, min_margin=2)


# Reranking ----------------------------------------------------------------------------

_COLLAPSED = """
SELECT game_id AS request_id, 'm' || (substr(accepted_uci, 2)::BIGINT % 4) AS uci, count(*) AS multiplicity, CAST(min(ply) AS INT) AS first_index,
  arg_min('raw ' || fen_before, ply) AS raw_response FROM moves GROUP BY 1, 2"""
_SCORES = """
SELECT *, CASE WHEN class = 'mate_missed' OR coalesce(cpl > 300, false) THEN true ELSE false END AS vetoed, coalesce(cpl::DOUBLE, -ranking,
    CASE WHEN class = 'mate_missed' THEN 1e6 ELSE 0 END) AS loss
FROM (SELECT *, CASE WHEN (request_id + k) % 4 = 0 THEN NULL ELSE (request_id * 7 + k * 131) % 600 END AS cpl,
        CASE WHEN (request_id + k) % 8 = 0 THEN ((request_id * 3 + k) % 30) / 10.0::DOUBLE END AS ranking,
        CASE WHEN (request_id * 5 + k) % 6 = 0 THEN 'mate_missed' ELSE 'good' END AS class
      FROM (SELECT *, substr(uci, 2)::BIGINT AS k FROM collapsed) a) b"""


def collapsed(fx: Fixtures) -> DataFrame:
    uci = F.concat(F.lit("m"), F.pmod(F.substring("accepted_uci", 2, 20).cast("long"), F.lit(4)).cast("string"))
    samples = fx.moves.select(F.col("game_id").alias("request_id"), F.col("ply").alias("sample_index"), uci.alias("uci"),
                              F.concat(F.lit("raw "), "fen_before").alias("raw_response"))
    return ops.collapse_samples(samples)


@query("collapsed_samples", with_views(["moves"], "SELECT * FROM collapsed", extra={"collapsed": _COLLAPSED}))
def collapsed_samples(fx: Fixtures) -> DataFrame:
    return collapsed(fx)


@query("veto_selection", with_views(["moves"], """
SELECT request_id, coalesce(safe.u, bad.u) AS chosen_uci, coalesce(safe.m, bad.m) AS chosen_multiplicity, first_legal_uci, n_legal, n_distinct_legal, n_vetoed,
  coalesce(safe.u, bad.u) <> first_legal_uci AS veto_changed_move, safe IS NULL AS all_vetoed
FROM (SELECT request_id, arg_min({'u': uci, 'm': multiplicity}, (-multiplicity, loss, first_index)) FILTER (NOT vetoed) AS safe,
        arg_min({'u': uci, 'm': multiplicity}, (loss, first_index)) AS bad, arg_min(uci, first_index) AS first_legal_uci,
        CAST(sum(multiplicity) AS BIGINT) AS n_legal, count(*) AS n_distinct_legal, count(*) FILTER (vetoed) AS n_vetoed FROM scores GROUP BY 1) x""",
    extra={"collapsed": _COLLAPSED, "scores": _SCORES}))
def veto_selection(fx: Fixtures) -> DataFrame:
    return ops.veto_selection(scored_samples(fx))


@query("rerank_records", with_views(["moves"], """
SELECT request_id, 'engine' AS scorer, 5 AS n_candidates_configured, 300 AS veto_cpl_threshold, n_candidates_generated, coalesce(n_legal, 0) AS n_legal,
  coalesce(n_distinct, 0) AS n_distinct_legal, coalesce(n_vetoed, 0) AS n_vetoed, coalesce(chosen.u <> first_uci, false) AS veto_changed_move,
  coalesce(safe IS NULL, false) AND n_legal IS NOT NULL AS all_vetoed, chosen.m AS chosen_multiplicity, chosen.u AS chosen_uci, first_uci AS first_legal_uci,
  coalesce(listed, '') AS candidates
FROM (SELECT game_id AS request_id, count(*) AS n_candidates_generated FROM moves GROUP BY 1) g LEFT JOIN (
  SELECT *, coalesce(safe, bad) AS chosen FROM (
    SELECT request_id, arg_min({'u': uci, 'm': multiplicity}, (-multiplicity, loss, first_index)) FILTER (NOT vetoed) AS safe,
      arg_min({'u': uci, 'm': multiplicity}, (loss, first_index)) AS bad, arg_min(uci, first_index) AS first_uci,
      CAST(sum(multiplicity) AS BIGINT) AS n_legal, count(*) AS n_distinct, count(*) FILTER (vetoed) AS n_vetoed,
      string_agg(concat_ws(':', uci, multiplicity::VARCHAR, cpl::VARCHAR, class, vetoed::VARCHAR), ' ' ORDER BY first_index) AS listed
    FROM scores WHERE request_id % 11 <> 0 GROUP BY 1) a) b USING (request_id)""", extra={"collapsed": _COLLAPSED, "scores": _SCORES}))
def rerank_records(fx: Fixtures) -> DataFrame:
    """No sample of every eleventh request is legal."""
    requests = fx.moves.groupBy(F.col("game_id").alias("request_id")).agg(F.count("*").alias("n_candidates_generated"))
    records = ops.rerank_records(requests, scored_samples(fx).where("request_id % 11 <> 0"), 5, "engine", 300)
    line = lambda c: F.concat_ws(":", c["uci"], c["multiplicity"].cast("string"), c["centipawn_loss"].cast("string"), c["classification"], c["vetoed"].cast("string"))
    return records.withColumn("candidates", F.array_join(F.transform("candidates", line), " "))


def scored_samples(fx: Fixtures) -> DataFrame:
    k = F.substring("uci", 2, 5).cast("long")
    r = F.col("request_id")
    scored = collapsed(fx).withColumns({
        "centipawn_loss": F.when(F.pmod(r + k, F.lit(4)) != 0, F.pmod(r * 7 + k * 131, F.lit(600))),
        "ranking_score": F.when(F.pmod(r + k, F.lit(8)) == 0, F.pmod(r * 3 + k, F.lit(30)) / 10.0),
        "classification": F.when(F.pmod(r * 5 + k, F.lit(6)) == 0, "mate_missed").otherwise("good"),
    })
    return scored.withColumn("vetoed", labels.vetoed(F.col("classification"), F.col("centipawn_loss"), 300))


@query("rerank_telemetry", with_views(["moves"], """
SELECT count(*) AS attempts, avg(5.0) AS avg_generated, round(avg(2 + ply % 4), 6) AS avg_legal, round(avg(1 + ply % 3), 6) AS avg_distinct_legal,
  round(avg(game_id % 3), 6) AS avg_vetoed, round(avg((game_id % 5 = 0)::INT), 6) AS changed_share, round(avg((game_id % 7 = 0)::INT), 6) AS all_vetoed_share,
  round(avg(1 + game_id % 2), 6) AS avg_chosen_multiplicity FROM moves WHERE l_returnflag = 'N'"""))
def rerank_telemetry(fx: Fixtures) -> DataFrame:
    return rounded(ops.telemetry_report(fx.attempts))
