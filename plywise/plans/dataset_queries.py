"""Game records, funnels, relabelling, mining, gates, mixes, caches and sinks."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plywise.functions import text
from plywise.operators import datasets as ops
from plywise.operators import games as games_ops
from plywise.operators import reuse
from plywise.operators.evaluation import with_legality
from plywise.operators.ordering import counters, dense_index, evenly_spaced
from plywise.plans.board_queries import evaluations, summary
from plywise.plans.candidate_queries import labelled, labelled_sql
from plywise.plans.fixtures import Fixtures, with_views
from plywise.plans.prediction_queries import _PREDICTIONS, checked_predictions
from plywise.plans.registry import query, rounded, written
from plywise.plans.sqltext import judged_sql, summary_sql
from plywise.schemas import ENGINE_RECORD
from plywise.session import shared_dir
from plywise.sources import gamefiles, records

MIN_ELO, MIN_PLIES, VAL_RATIO, SEED = 1700, 3, 0.2, 3


def _scratch(fx: Fixtures, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(fx.spark)}/{name}-{uuid4().hex}"


# Game records ---------------------------------------------------------------------------

_TAGS = """
SELECT o_orderkey AS game_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Rated Bullet game' WHEN '2-HIGH' THEN 'Rated Blitz game'
    WHEN '3-MEDIUM' THEN 'Casual game' WHEN '4-NOT SPECIFIED' THEN 'Rated game' ELSE 'Friendly' END AS event,
  CASE o_custkey % 3 WHEN 0 THEN '60+0' WHEN 1 THEN '120+2' ELSE '-' END AS control, 1500 + o_custkey % 1000 AS white_elo,
  CASE WHEN o_orderkey % 13 = 0 THEN '?' ELSE CAST(1600 + o_orderkey % 900 AS VARCHAR) END AS black_elo,
  CASE o_orderstatus WHEN 'P' THEN 'Time forfeit' ELSE 'Normal' END AS termination,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'W' || o_custkey AS white, 'É' || o_orderkey AS black FROM orders"""
_RECORDS = """
SELECT t.*, m.sans, coalesce(len(m.sans), 0) AS plies, CASE
    WHEN NOT (event LIKE 'Rated %' OR event = 'Friendly') THEN 'unrated'
    WHEN event LIKE '%Bullet%' OR (event NOT LIKE '%Blitz%' AND control <> '120+2') THEN 'time_control_too_fast_or_unknown'
    WHEN black_elo = '?' OR white_elo < 1700 OR CAST(nullif(black_elo, '?') AS INT) < 1700 THEN 'elo_below_threshold_or_missing'
    WHEN termination <> 'Normal' THEN 'non_normal_termination' WHEN coalesce(len(m.sans), 0) < 3 THEN 'too_few_plies' END AS skip_reason,
  substr(sha256('{"black":"\\u00c9' || game_id || '","date":"' || date || '","moves":[' ||
    coalesce('"' || array_to_string(m.sans, '","') || '"', '') || '],"round":"?","site":"g' || game_id || '","white":"' || white || '"}'), 1, 16) AS game_key
FROM tags t LEFT JOIN (SELECT game_id, list(accepted_san ORDER BY ply) AS sans FROM moves GROUP BY 1) m USING (game_id)"""
_SPLIT = """
SELECT *, CASE WHEN CAST('0x' || substr(sha256('3-split|' || game_key), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'val' ELSE 'train' END AS split FROM records"""
RECORD_CTES = {"tags": _TAGS, "records": _RECORDS, "splits": _SPLIT}


def record_texts(fx: Fixtures) -> DataFrame:
    """Game records in portable notation, written from orders and lines."""
    o = fx.orders
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    priority = F.col("o_orderpriority")
    event = (F.when(priority == "1-URGENT", "Rated Bullet game").when(priority == "2-HIGH", "Rated Blitz game")
             .when(priority == "3-MEDIUM", "Casual game").when(priority == "4-NOT SPECIFIED", "Rated game").otherwise("Friendly"))
    control = F.when(cust % 3 == 0, "60+0").when(cust % 3 == 1, "120+2").otherwise("-")
    tags = {
        "Event": event, "Site": F.concat(F.lit("g"), key.cast("string")), "Date": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "White": F.concat(F.lit("W"), cust.cast("string")), "Black": F.concat(F.lit("É"), key.cast("string")),
        "WhiteElo": (1500 + cust % 1000).cast("string"),
        "BlackElo": F.when(key % 13 == 0, "?").otherwise((1600 + key % 900).cast("string")), "TimeControl": control,
        "Termination": F.when(F.col("o_orderstatus") == "P", "Time forfeit").otherwise("Normal"),
        "Rated": F.when(event == "Friendly", "Yes"),
    }
    line = lambda name, value: F.concat(F.lit(f'[{name} "'), value, F.lit('"]'))
    head = F.concat_ws("\n", *[line(k, v) for k, v in tags.items()])
    number = lambda m: F.when(m["ply"] % 2 == 1, F.concat((F.floor(m["ply"] / 2) + 1).cast("string"), F.lit(". "))).otherwise("")
    played = fx.moves.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("ply", "accepted_san"))).alias("m"))
    body = F.array_join(F.transform("m", lambda m: F.concat(number(m), m["accepted_san"], F.when(m["ply"] == 2, " {a comment (x)} $2").otherwise(""))), " ")
    joined = o.join(played, o["o_orderkey"] == played["game_id"], "left")
    movetext = F.concat(F.coalesce(body, F.lit("")), F.when(F.col("m").isNotNull(), " ").otherwise(""), F.lit("1-0"))
    return joined.select(key.alias("game_id"), F.concat(head, F.lit("\n\n"), movetext).alias("record"))


def parsed_records(fx: Fixtures) -> DataFrame:
    games = gamefiles.parse_games(record_texts(fx), "record").withColumn("plies", F.size("moves"))
    return games.withColumns({
        "skip_reason": ops.skip_reason(F.col("headers"), F.col("plies"), MIN_ELO, MIN_PLIES),
        "game_key": gamefiles.game_key(F.col("headers"), F.col("moves")),
    })


def split_records(fx: Fixtures) -> DataFrame:
    return parsed_records(fx).withColumn("split", ops.game_split(F.col("game_key"), VAL_RATIO, SEED))


def _record_sql(body: str, extra: dict[str, str] | None = None) -> str:
    return with_views(["moves"], body, extra={**RECORD_CTES, **(extra or {})})


@query("game_records", _record_sql("""
SELECT game_id, event, 'g' || game_id AS site, white, black, '?' AS round, CAST(plies AS INT) AS plies, coalesce(array_to_string(sans, ' '), '') AS moves FROM records"""))
def game_records(fx: Fixtures) -> DataFrame:
    fields = gamefiles.source_struct(F.col("headers"))
    return parsed_records(fx).withColumn("s", fields).select(
        "game_id", "s.event", "s.site", "s.white", "s.black", "s.round", "plies", F.array_join("moves", " ").alias("moves"))


@query("game_files_round_trip", _record_sql("""
SELECT 'g' || game_id AS site, event, CAST(plies AS INT) AS plies, coalesce(array_to_string(sans, ' '), '') AS moves FROM records"""))
def game_files_round_trip(fx: Fixtures) -> DataFrame:
    path = _scratch(fx, "records")
    record_texts(fx).select(F.concat("record", F.lit("\n"))).write.text(path)
    games = gamefiles.read_games(fx.spark, path)
    tag = lambda name: gamefiles.tag(F.col("headers"), name)
    return games.select(tag("Site").alias("site"), tag("Event").alias("event"), F.size("moves").alias("plies"), F.array_join("moves", " ").alias("moves"))


@query("quality_funnel", _record_sql("SELECT game_id, skip_reason, game_key, split FROM splits"))
def quality_funnel(fx: Fixtures) -> DataFrame:
    return split_records(fx).select("game_id", "skip_reason", "game_key", "split")


@query("funnel_stats", _record_sql("""
SELECT 'games_seen' AS metric, '' AS key, count(*) AS n FROM splits
UNION ALL SELECT 'games_kept', '', count(*) FROM splits WHERE skip_reason IS NULL
UNION ALL SELECT 'examples_train', '', CAST(coalesce(sum(least(plies, 4)) FILTER (split = 'train' AND skip_reason IS NULL), 0) AS BIGINT) FROM splits
UNION ALL SELECT 'examples_val', '', CAST(coalesce(sum(least(plies, 4)) FILTER (split = 'val' AND skip_reason IS NULL), 0) AS BIGINT) FROM splits
UNION ALL SELECT 'skipped_games', skip_reason, count(*) FROM splits WHERE skip_reason IS NOT NULL GROUP BY 2"""))
def funnel_stats(fx: Fixtures) -> DataFrame:
    written = F.when(F.col("skip_reason").isNull(), F.least("plies", F.lit(4)))
    return ops.funnel_stats(split_records(fx).withColumn("written", written))


_PICKS = """
CASE WHEN k >= plies THEN range(plies) WHEN k = 1 THEN [plies // 2]
     ELSE list_distinct([CAST(round_even(i * (plies - 1) / (k - 1.0), 0) AS BIGINT) FOR i IN range(k)]) END"""


@query("capped_samples", _record_sql(f"""
SELECT game_id, array_to_string(list_sort({_PICKS}), ',') AS picks FROM (
  SELECT *, CAST(least(4, 5000 - before) AS BIGINT) AS k FROM (
    SELECT *, coalesce(sum(least(plies, 4)) OVER (ORDER BY game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM records WHERE skip_reason IS NULL) a WHERE before < 5000) b"""))
def capped_samples(fx: Fixtures) -> DataFrame:
    kept = parsed_records(fx).where("skip_reason IS NULL").select(F.col("game_id").alias("source_game_index"), "plies")
    sampled = ops.capped_samples(kept, max_per_game=4, max_examples=5000)
    return sampled.select(F.col("source_game_index").alias("game_id"), F.array_join(F.col("sample_indices").cast("array<string>"), ",").alias("picks"))


@query("evenly_spaced_positions", _record_sql(f"""
SELECT game_id, array_to_string(list_sort({_PICKS}), ',') AS picks FROM (SELECT game_id, plies, 1 + game_id % 5 AS k FROM records WHERE plies > 0) a"""))
def evenly_spaced_positions(fx: Fixtures) -> DataFrame:
    sizes = fx.moves.groupBy("game_id").agg(F.count("*").alias("plies"))
    picks = evenly_spaced(F.col("plies"), 1 + F.pmod("game_id", F.lit(5)))
    return sizes.select("game_id", F.array_join(picks.cast("array<string>"), ",").alias("picks"))


def examples(fx: Fixtures, max_per_game: int | None = None) -> DataFrame:
    arrays = fx.moves.groupBy("game_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ply", F.struct(F.col("fen_before").alias("fen"), F.col("accepted_san").alias("san"), F.col("accepted_uci").alias("uci")).alias("m")))),
        lambda x: x["m"]).alias("moves"))
    split = ops.game_split(F.col("game_id"), VAL_RATIO, SEED)
    rows = ops.example_rows(arrays.withColumn("split", split), max_per_game)
    return rows.withColumns({"legality_mode": ops.row_mode(0.3, SEED, F.col("game_id"), F.col("ply")), "prompt_version": F.lit("strict-v7")})


_EXAMPLES = """
SELECT game_id, ply, accepted_uci AS move, fen_before AS fen, '{"move":"' || accepted_uci || '"}' AS completion,
  CASE WHEN CAST('0x' || substr(sha256('3-split|' || game_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'val' ELSE 'train' END AS split,
  CASE WHEN CAST('0x' || substr(sha256('3-mode|' || game_id || '|' || ply), 1, 8) AS BIGINT) / 4294967296.0 < 0.3 THEN 'constrained' ELSE 'open' END AS legality_mode
FROM moves"""


@query("every_position_examples", with_views(["moves"], "SELECT * FROM examples", extra={"examples": _EXAMPLES}))
def every_position_examples(fx: Fixtures) -> DataFrame:
    return examples(fx).select("game_id", "ply", "move", "fen", "completion", "split", "legality_mode")


@query("split_audit", with_views(["moves"], """
SELECT split, count(*) AS rows, count(DISTINCT game_id) AS games, count(*) FILTER (legality_mode = 'open') AS open_rows,
  count(*) FILTER (legality_mode = 'constrained') AS constrained_rows, CAST(1 AS BIGINT) AS prompt_versions, CAST(0 AS BIGINT) AS bad_completions
FROM examples GROUP BY split""", extra={"examples": _EXAMPLES}))
def split_audit(fx: Fixtures) -> DataFrame:
    return ops.split_audit(examples(fx))


@query("shared_games", with_views(["moves"], """
SELECT count(*) AS shared_games FROM (SELECT game_id FROM examples WHERE split = 'train' INTERSECT SELECT game_id FROM examples WHERE split = 'val') x""",
    extra={"examples": _EXAMPLES}))
def shared_games(fx: Fixtures) -> DataFrame:
    return ops.shared_games(examples(fx))


# Relabelling ------------------------------------------------------------------------------

_HUMAN = """
SELECT doc_id AS line_index, text AS prompt, 'h' || n_chars % 9 AS move, 'H' || n_chars % 9 AS san, '{"move":"h' || n_chars % 9 || '"}' AS completion,
  CASE WHEN n_chars % 17 <> 0 THEN 'h' || n_chars % 7 END AS best, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id * 37 % 250 AS INT) END AS cpl,
  CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'mate_missed' WHEN doc_id * 37 % 250 <= 80 THEN 'good' ELSE 'mistake' END AS class FROM documents"""


def human_examples(fx: Fixtures) -> DataFrame:
    n, d = F.col("n_chars"), F.col("doc_id")
    tagged = lambda p, m: F.concat(F.lit(p), F.pmod(n, F.lit(m)).cast("string"))
    loss = F.pmod(d * 37, F.lit(250)).cast("int")
    return fx.documents.select(
        d.alias("line_index"), F.col("text").alias("prompt"), tagged("h", 9).alias("move"), tagged("H", 9).alias("san"),
        F.concat(F.lit('{"move":"'), tagged("h", 9), F.lit('"}')).alias("completion"),
        F.when(n % 17 != 0, tagged("h", 7)).alias("best_move_uci"), F.when(n % 17 != 0, tagged("B", 7)).alias("best_move_san"),
        F.when(d % 5 != 0, loss).alias("human_centipawn_loss"),
        F.when(d % 23 == 0, F.lit(None).cast("string")).when(d % 5 == 0, "mate_missed").when(loss <= 80, "good").otherwise("mistake").alias("human_classification"),
    )


@query("relabel_distill", f"""
SELECT min(line_index) AS line_index, arg_min(best, line_index) AS move, arg_min('B' || substr(best, 2), line_index) AS san, '{{"move":"' || best || '"}}' AS completion
FROM ({_HUMAN}) h WHERE class IS NOT NULL AND best IS NOT NULL GROUP BY prompt, best""")
def relabel_distill(fx: Fixtures) -> DataFrame:
    return ops.relabelled(human_examples(fx), "distill").select("line_index", "move", "san", "completion")


@query("relabel_filter", f"""
SELECT min(line_index) AS line_index, completion FROM ({_HUMAN}) h WHERE class <> 'mate_missed' AND (cpl IS NULL OR cpl <= 100) GROUP BY prompt, completion""")
def relabel_filter(fx: Fixtures) -> DataFrame:
    return ops.relabelled(human_examples(fx), "filter").select("line_index", "completion")


@query("relabel_stats", f"""
SELECT count(*) AS rows_read, (SELECT count(*) FROM (SELECT DISTINCT prompt, best FROM ({_HUMAN}) x WHERE class IS NOT NULL AND best IS NOT NULL) d) AS rows_written,
  count(*) FILTER (class IS NULL) AS dropped_invalid_row, count(*) FILTER (class IS NOT NULL AND best IS NULL) AS dropped_no_best_move,
  CAST(0 AS BIGINT) AS dropped_filtered, count(*) FILTER (class IS NOT NULL AND best = move) AS human_matches_engine,
  round_even(avg(cpl) FILTER (class IS NOT NULL), 2) AS human_avg_cpl,
  count(*) FILTER (class IS NOT NULL AND best IS NOT NULL) - (SELECT count(*) FROM (SELECT DISTINCT prompt, best FROM ({_HUMAN}) x WHERE class IS NOT NULL AND best IS NOT NULL) d) AS dropped_duplicate,
  round_even(count(*) FILTER (class IS NOT NULL AND best = move) / count(*), 4) AS human_engine_agreement_rate FROM ({_HUMAN}) h""")
def relabel_stats(fx: Fixtures) -> DataFrame:
    return ops.relabel_stats(human_examples(fx))


@query("relabel_class_histogram", f"SELECT 'human_classification' AS metric, class AS key, count(*) AS n FROM ({_HUMAN}) h WHERE class IS NOT NULL GROUP BY 2")
def relabel_class_histogram(fx: Fixtures) -> DataFrame:
    return counters(human_examples(fx), {"human_classification": F.col("human_classification")})


# Mining and gates ---------------------------------------------------------------------------

_ERRORS = """
SELECT run_id, game_id, move_id, ply, fen_before AS fen, accepted_uci, best_move_uci, centipawn_loss, classification, prompt,
  (CASE classification WHEN 'blunder' THEN 0 WHEN 'mate_missed' THEN 1 ELSE 2 END, -coalesce(centipawn_loss, 1000000), run_id, game_id, ply) AS o,
  CASE WHEN prompt IS NULL THEN 'missing' WHEN best_move_uci = accepted_uci THEN 'best' END AS drop
FROM moves JOIN games USING (game_id) JOIN evaluations USING (move_id)
LEFT JOIN (SELECT move_id, arg_min(raw_prompt, attempt_number) AS prompt FROM attempts WHERE move_id IS NOT NULL AND raw_prompt IS NOT NULL GROUP BY 1) p USING (move_id)
WHERE classification IN ('blunder', 'mate_missed') OR centipawn_loss >= 250"""
_FIRST_ERRORS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fen ORDER BY o) AS nth FROM errors WHERE drop IS NULL) x WHERE nth = 1"
_KEPT_ERRORS = "SELECT * FROM first_errors ORDER BY o LIMIT 2000"
_ERROR_CTES = {"errors": _ERRORS, "first_errors": _FIRST_ERRORS, "kept": _KEPT_ERRORS}


def mined(fx: Fixtures) -> DataFrame:
    fx.number_lines()
    return ops.mined_errors(fx.moves, fx.games, evaluations(fx), games_ops.first_prompts(fx.attempts), run_ids=None)


def _error_sql(body: str) -> str:
    return judged_sql(["moves", "games", "attempts"], body, _ERROR_CTES)


@query("error_examples", _error_sql("""
SELECT fen, prompt, coalesce(best_move_uci, accepted_uci) AS move, run_id AS source_run_id, move_id AS source_move_id, accepted_uci AS model_bad_move,
  centipawn_loss AS model_centipawn_loss, classification AS model_classification FROM first_errors"""))
def error_examples(fx: Fixtures) -> DataFrame:
    return ops.error_examples(mined(fx)).select("fen", "prompt", "move", "source_run_id", "source_move_id", "model_bad_move", "model_centipawn_loss", "model_classification")


def _error_stats_sql(source: str, bound: str) -> str:
    return f"""
SELECT 'candidates' AS metric, '' AS key, count(*) AS n FROM errors {bound}
UNION ALL SELECT 'dropped_missing_prompt', '', count(*) FILTER (drop = 'missing') FROM errors {bound}
UNION ALL SELECT 'dropped_best_equals_accepted', '', count(*) FILTER (drop = 'best') FROM errors {bound}
UNION ALL SELECT 'dropped_duplicate_fen', '', count(*) FILTER (drop IS NULL) - (SELECT count(*) FROM {source}) FROM errors {bound}
UNION ALL SELECT 'written', '', count(*) FROM {source}
UNION ALL SELECT 'by_run', run_id::VARCHAR, count(*) FROM {source} GROUP BY 2
UNION ALL SELECT 'by_classification', classification, count(*) FROM {source} GROUP BY 2"""


@query("error_stats", _error_sql(_error_stats_sql("first_errors", "")))
def error_stats(fx: Fixtures) -> DataFrame:
    return ops.error_stats(mined(fx))


@query("error_stats_capped", _error_sql(_error_stats_sql("kept", "WHERE (SELECT count(*) FROM kept) < 2000 OR o <= (SELECT max(o) FROM kept)")))
def error_stats_capped(fx: Fixtures) -> DataFrame:
    return ops.error_stats(mined(fx), max_examples=2000)


_GATE_PREDICTIONS = """
SELECT p.*, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS file_ord, CASE WHEN l_linestatus = 'O' THEN 'open_file' ELSE 'closed_file' END AS gate_source
FROM predictions p JOIN moves m USING (move_id)"""
_TRIGGERS = """
SELECT p.*, d.prompt, d.completion, d.target FROM gate_predictions p
JOIN (SELECT fen_before AS fen, arg_max('play ' || fen_before || ' ' || ply, move_id) AS prompt, arg_max('{"move":"' || accepted_uci || '"}', move_id) AS completion,
        arg_max(accepted_uci, move_id) AS target FROM moves WHERE l_returnflag <> 'R' GROUP BY 1) d USING (fen)
WHERE p.centipawn_loss >= 250 OR p.classification = 'blunder'"""
_GATED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fen ORDER BY file_ord, move_id) AS nth FROM triggers) x WHERE nth = 1"
_GATE_CTES = {"predictions": _PREDICTIONS, "gate_predictions": _GATE_PREDICTIONS, "triggers": _TRIGGERS, "gated": _GATED}


def _gate_sql(body: str) -> str:
    return judged_sql(["attempts", "moves", "legal_moves"], body, _GATE_CTES)


def gate_inputs(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    """Predictions in two ordered 'files', and the first triggers, with the dataset rows they are looked up in.

    Only a legal move has an engine label, so a trigger is one of the moves with such a label; the others are left out
    before legality is looked up.
    """
    fx.number_lines()
    is_open = F.col("l_linestatus") == "O"
    moves = fx.moves.select("game_id", "ply", F.col("move_id").alias("line_ord"), F.col("fen_before").alias("fen"), is_open.alias("open"))
    attempts = fx.attempts.select("game_id", "ply", "parsed_move", "parse_ok")
    judged = evaluations(fx).select(F.col("move_id").alias("line_ord"), "centipawn_loss", "classification").where(ops.is_trigger())
    lost = attempts.where("parse_ok").join(moves.join(judged, "line_ord"), ["game_id", "ply"]).select(
        "fen", "parsed_move", "centipawn_loss", "classification", F.when(F.col("open"), 0).otherwise(1).alias("file_ord"),
        F.when(F.col("open"), "open_file").otherwise("closed_file").alias("gate_source"), "line_ord")
    preds = attempts.join(moves, ["game_id", "ply"])
    rows = fx.moves.where("l_returnflag <> 'R'").select(
        F.col("fen_before").alias("fen"), F.concat_ws(" ", F.lit("play"), "fen_before", F.col("ply").cast("string")).alias("prompt"),
        F.concat(F.lit('{"move":"'), "accepted_uci", F.lit('"}')).alias("completion"), F.col("accepted_uci").alias("move"), F.col("move_id").alias("row_index"))
    return preds, ops.gate_triggers(with_legality(lost, fx.legal_moves).where("legal_ok"), rows)


@query("tactical_gate", _gate_sql("""
SELECT fen, prompt, completion, target AS move, gate_source, coalesce(parsed_move, '') AS gate_trigger_move, centipawn_loss AS gate_trigger_cpl,
  classification AS gate_trigger_classification FROM gated"""))
def tactical_gate(fx: Fixtures) -> DataFrame:
    return ops.tactical_gate(gate_inputs(fx)[1]).select(
        "fen", "prompt", "completion", "move", "gate_source", "gate_trigger_move", "gate_trigger_cpl", "gate_trigger_classification")


@query("tactical_gate_first", _gate_sql("SELECT fen, move_id AS line_ord, gate_source FROM gated ORDER BY file_ord, move_id LIMIT 300"))
def tactical_gate_first(fx: Fixtures) -> DataFrame:
    return ops.tactical_gate(gate_inputs(fx)[1], 300).select("fen", "line_ord", "gate_source")


@query("tactical_gate_stats", _gate_sql("""
SELECT 'prediction_rows' AS metric, '' AS key, count(*) AS n FROM gate_predictions
UNION ALL SELECT 'selected_rows', '', count(*) FROM gated
UNION ALL SELECT 'dropped_duplicate_fen', '', (SELECT count(*) FROM triggers) - count(*) FROM gated
UNION ALL SELECT 'by_source', gate_source, count(*) FROM gated GROUP BY 2
UNION ALL SELECT 'by_classification', classification, count(*) FROM gated GROUP BY 2"""))
def tactical_gate_stats(fx: Fixtures) -> DataFrame:
    preds, triggers = gate_inputs(fx)
    triggers = written(fx, triggers, "triggers")
    return ops.gate_stats(preds, triggers, ops.tactical_gate(triggers))


# Mixing and paging ----------------------------------------------------------------------------

_MIXED = """
SELECT text AS prompt, 'd' || doc_id AS fen, '' AS completion, coalesce(lang, '') AS move, 'broad' AS source FROM (
  SELECT * FROM documents ORDER BY sha256('4|d' || doc_id), doc_id LIMIT 300) d
UNION ALL SELECT text, 'b' || item_id, 'c' || item_id, '', 'tactical_gate_r' || r FROM benchmark, (SELECT unnest(range(1, 4)) AS r) k"""


def mixed(fx: Fixtures) -> DataFrame:
    none = F.lit(None).cast("string")
    broad = fx.documents.select(F.col("text").alias("prompt"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("fen"),
                                none.alias("completion"), F.col("lang").alias("move"))
    tactical = fx.benchmark.select(F.col("text").alias("prompt"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("fen"),
                                   F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("completion"), none.alias("move"))
    return ops.mixed_rows(broad, tactical, 300, 3, 4, "fen")


@query("mixed_rows", "SELECT * FROM (" + _MIXED + ") m")
def mixed_rows(fx: Fixtures) -> DataFrame:
    return mixed(fx)


@query("mixed_counts", "SELECT 'by_source' AS metric, source AS key, count(*) AS n FROM (" + _MIXED + ") m GROUP BY 2")
def mixed_counts(fx: Fixtures) -> DataFrame:
    return counters(mixed(fx), {"by_source": F.col("source")})


@query("position_page", labelled_sql("""
SELECT fen, origin FROM (SELECT fen, arg_min(origin, (s, seq)) AS origin, min((s, seq)) AS o FROM (
  SELECT fen_before AS fen, 'input' AS origin, 0 AS s, seq FROM labelled WHERE split = 'train'
  UNION ALL SELECT fen_before, 'arena_db', 1, move_id FROM moves) a GROUP BY 1) b ORDER BY o LIMIT 4000 OFFSET 9000""", views=("moves",)))
def position_page(fx: Fixtures) -> DataFrame:
    page = ops.page_positions([
        ops.position_records(labelled(fx), "train"),
        ops.position_records(fx.moves.withColumn("seq", F.col("move_id")), None, "arena_db"),
    ], offset=9000, max_positions=4000)
    return page.select("fen", "origin")


@query("positions_distinct", labelled_sql("""
SELECT fen, min(s) AS source_ord FROM (SELECT fen_before AS fen, 0 AS s FROM labelled WHERE split = 'test' UNION ALL SELECT fen_before, 1 FROM moves) a GROUP BY 1""", views=("moves",)))
def positions_distinct(fx: Fixtures) -> DataFrame:
    return ops.page_positions([
        ops.position_records(labelled(fx), "test"),
        ops.position_records(fx.moves.withColumn("seq", F.col("move_id")), None, "arena_db"),
    ]).select("fen", "source_ord")


# Caches, dimensions, validation -----------------------------------------------------------------

_REQUESTS = "SELECT attempt_id, fen, parsed_move AS uci FROM predictions WHERE legal_ok"
_STORED = """
SELECT fen_before AS fen, candidate_uci AS uci, arg_max(classification, seq) AS classification, arg_max(coalesce(centipawn_loss, -1), seq) AS cpl
FROM candidates WHERE source IN ('arena_move', 'arena_blunder') GROUP BY 1, 2"""
_CACHE_CTES = {"predictions": _PREDICTIONS, "requests": _REQUESTS, "stored": _STORED}


def _cache_sql(body: str) -> str:
    return judged_sql(["attempts", "moves", "legal_moves", "candidates"], body, _CACHE_CTES)


def stored_cache(fx: Fixtures) -> DataFrame:
    """Evaluation cache read back from JSON lines, some of them unreadable."""
    record = F.struct(F.col("classification"), F.col("centipawn_loss"), F.col("best_move_uci"))
    key = text.evaluation_key(F.col("fen_before"), F.col("candidate_uci"))
    line = F.to_json(F.struct(key.alias("key"), record.alias("evaluation")))
    lines = fx.candidates.where(F.col("source").isin("arena_move", "arena_blunder", "stockfish_good")).select(
        F.col("seq").alias("line_index"), F.when(F.col("source") == "stockfish_good", F.concat(F.lit("{broken"), line)).otherwise(line).alias("value"))
    return reuse.load_cache(lines, ENGINE_RECORD)


def cache_requests(fx: Fixtures) -> DataFrame:
    """Legal moves of predictions; their labels are not asked for."""
    fx.number_lines()
    return checked_predictions(fx).where("legal_ok").select("attempt_id", "fen", F.col("parsed_move").alias("uci"))


@query("evaluation_cache", _cache_sql("SELECT sha256(fen || '|' || uci) AS key, classification, nullif(cpl, -1) AS centipawn_loss FROM stored"))
def evaluation_cache(fx: Fixtures) -> DataFrame:
    return stored_cache(fx).select("key", "evaluation.classification", "evaluation.centipawn_loss")


@query("cache_hits", _cache_sql("SELECT attempt_id, s.classification FROM requests JOIN stored s USING (fen, uci)"))
def cache_hits(fx: Fixtures) -> DataFrame:
    return reuse.cache_lookup(cache_requests(fx), stored_cache(fx))[0].select("attempt_id", "evaluation.classification")


@query("cache_stats", _cache_sql("""
SELECT (SELECT count(*) FROM requests) AS requests, count(*) AS cache_misses, (SELECT count(*) FROM requests) - count(*) AS cache_hits
FROM (SELECT DISTINCT fen, uci FROM requests WHERE (fen, uci) NOT IN (SELECT (fen, uci) FROM stored)) m"""))
def cache_stats(fx: Fixtures) -> DataFrame:
    return reuse.cache_stats(cache_requests(fx), stored_cache(fx))


@query("cache_growth", _cache_sql("""
SELECT DISTINCT sha256(fen || '|' || uci) AS key, fen, uci, length(fen) * 10 + length(uci) AS cpl FROM requests WHERE (fen, uci) NOT IN (SELECT (fen, uci) FROM stored)"""))
def cache_growth(fx: Fixtures) -> DataFrame:
    """Misses evaluated by own code in Arrow batches."""
    _, misses = reuse.cache_lookup(cache_requests(fx), stored_cache(fx))

    def make():
        return lambda fen, uci: {"cpl": len(fen) * 10 + len(uci)}

    return reuse.evaluate_with(misses, make, "cpl BIGINT").select(
        text.evaluation_key(F.col("fen"), F.col("uci")).alias("key"), "fen", "uci", "cpl")


@query("candidate_scores", with_views(["legal_moves"], """
SELECT fen, uci, CAST(length(fen) * 20 AS INT) AS centipawn_loss, length(fen) * 20 > 120 AS vetoed FROM legal_moves"""))
def candidate_scores(fx: Fixtures) -> DataFrame:
    cpl = lambda f: (F.char_length(f) * 20).cast("int")
    scorer = lambda f, u: F.struct(cpl(f).alias("centipawn_loss"), (cpl(f) > 120).alias("vetoed"))
    return reuse.score_with(fx.legal_moves, scorer)


@query("predictor_rows", """
SELECT doc_id, lower(substr(lang, 1, 1)) || length(text) AS parsed_move FROM documents""")
def predictor_rows(fx: Fixtures) -> DataFrame:
    def predict(batch):
        return batch.assign(parsed_move=batch["lang"].str[:1].str.lower() + batch["text"].str.len().astype(str))[["doc_id", "parsed_move"]]

    return reuse.predict_with(fx.documents.select("doc_id", "lang", "text"), predict, "doc_id BIGINT, parsed_move STRING")


@query("dimension_rows", """
WITH have AS (SELECT n_nationkey + 100 AS prompt_id, 'Brand#' || n_nationkey AS version, 'ECONOMY' AS mode FROM nation),
new AS (SELECT DISTINCT p_brand AS version, p_type AS mode FROM part WHERE (p_brand, p_type) NOT IN (SELECT (version, mode) FROM have))
SELECT CAST(prompt_id AS BIGINT) AS prompt_id, version, mode FROM have
UNION ALL SELECT (SELECT max(prompt_id) FROM have) + row_number() OVER (ORDER BY sha256(version || chr(31) || mode)), version, mode FROM new""")
def dimension_rows(fx: Fixtures) -> DataFrame:
    have = fx.nation.select((F.col("n_nationkey") + 100).cast("long").alias("prompt_id"),
                            F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("version"), F.lit("ECONOMY").alias("mode"))
    new = fx.part.select(F.col("p_brand").alias("version"), F.col("p_type").alias("mode"))
    return reuse.ensure_dimension(new, have, ["version", "mode"], "prompt_id")


@query("config_fingerprints", """
SELECT p_partkey, sha256('{"competitors": ["' || p_brand || '", "' || p_type || '"], "name": "' || p_name || '", "options": {"nodes": ' || p_size ||
  ', "path": null}, "seed": ' || p_partkey || ', "strict": ' || CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END || '}') AS config_hash FROM part""")
def config_fingerprints(fx: Fixtures) -> DataFrame:
    payload = text.sorted_json({
        "name": F.col("p_name"), "competitors": F.array("p_brand", "p_type"), "seed": F.col("p_partkey"), "strict": F.col("p_size") > 20,
        "options": {"path": F.lit(None).cast("string"), "nodes": F.col("p_size")},
    })
    return fx.part.select("p_partkey", F.sha2(payload, 256).alias("config_hash"))


@query("row_validation", with_views(["candidates"], """
SELECT seq, CASE WHEN seq % 7 = 0 THEN 'missing required fields: source, score' WHEN seq % 5 = 0 THEN 'has non-integer score'
  WHEN seq % 11 = 0 THEN 'has non-integer centipawn_loss' END AS reject FROM candidates"""))
def row_validation(fx: Fixtures) -> DataFrame:
    seq = F.col("seq")
    rest = F.when(seq % 7 == 0, "").when(seq % 5 == 0, ',"source":"x","score":1.5').otherwise(',"source":"x","score":3')
    cpl = F.when(seq % 11 == 0, ',"centipawn_loss":"9"').otherwise(',"centipawn_loss":null')
    line = F.concat(F.lit('{"fen_before":"'), "fen_before", F.lit('","candidate_uci":"u","risk":"good"'), rest, cpl, F.lit("}"))
    rows = fx.candidates.select("seq", F.try_parse_json(line).alias("record"))
    return records.require_fields(rows, ["fen_before", "candidate_uci", "source", "risk", "score"], ["score"],
                                  ["centipawn_loss", "candidate_rank_in_generator"]).select("seq", "reject")


@query("text_keys", "SELECT doc_id, sha256(text) AS text_hash, sha256(coalesce(lang, '') || '|' || source) AS pair_key FROM documents")
def text_keys(fx: Fixtures) -> DataFrame:
    pair = text.evaluation_key(F.coalesce("lang", F.lit("")), F.col("source"))
    return fx.documents.select("doc_id", text.text_hash(F.col("text")).alias("text_hash"), pair.alias("pair_key"))


@query("choice_index_numbers", with_views(["candidates"], """
SELECT fen_before, row_number() OVER (ORDER BY min(seq)) - 1 AS position_index FROM candidates GROUP BY 1"""))
def choice_index_numbers(fx: Fixtures) -> DataFrame:
    seen = fx.candidates.groupBy("fen_before").agg(F.min("seq").alias("seq"))
    return dense_index(seen, "seq", "position_index").select("fen_before", "position_index")


# Sinks ------------------------------------------------------------------------------------------


@query("build_sidecar", with_views(["candidates"], """
SELECT '{"config":{"cap":3,"mode":"all"},"stats":{"positions":' || count(DISTINCT fen_before) || ',"rows":' || count(*) || '}}' AS value FROM candidates"""))
def build_sidecar(fx: Fixtures) -> DataFrame:
    stats = fx.candidates.agg(F.count("*").alias("rows"), F.countDistinct("fen_before").alias("positions"))
    return records.sidecar({"mode": "all", "cap": 3}, stats)


@query("record_lines_round_trip", labelled_sql("""
SELECT seq, fen_before, source, centipawn_loss, candidate_rank_in_generator FROM labelled"""))
def record_lines_round_trip(fx: Fixtures) -> DataFrame:
    path = _scratch(fx, "rows")
    columns = ["seq", "fen_before", "source", "centipawn_loss", "candidate_rank_in_generator"]
    records.write_jsonl(labelled(fx), path, columns)
    schema = "seq BIGINT, fen_before STRING, source STRING, centipawn_loss INT, candidate_rank_in_generator INT"
    return records.read_jsonl(fx.spark, path, schema, strict=True)


@query("split_sink_round_trip", labelled_sql("SELECT split, count(*) AS rows, CAST(sum(seq) AS BIGINT) AS total FROM labelled GROUP BY 1"))
def split_sink_round_trip(fx: Fixtures) -> DataFrame:
    path = _scratch(fx, "splits")
    records.write_splits(labelled(fx).select("split", "seq", "candidate_uci"), path)
    back = fx.spark.read.schema("seq BIGINT, candidate_uci STRING, split STRING").json(path)
    return back.groupBy("split").agg(F.count("*").alias("rows"), F.sum("seq").alias("total"))


@query("summary_store_replace", summary_sql("SELECT summary_id, run_id, games_played, wins, round(avg_cpl, 6) AS avg_cpl FROM summary"))
def summary_store_replace(fx: Fixtures) -> DataFrame:
    """Write all summaries, those of one run with a wrong number, then replace that run's partition."""
    path = _scratch(fx, "summaries")
    rows = summary(fx).select("summary_id", "run_id", "games_played", "wins", "avg_cpl")
    wrong = F.when(F.col("run_id") == 10, F.col("games_played") + 1).otherwise(F.col("games_played"))
    records.replace_summaries(rows.withColumn("games_played", wrong), path)
    records.replace_summaries(rows.where("run_id = 10"), path, only_given_runs=True)
    return rounded(fx.spark.read.parquet(path).select("summary_id", F.col("run_id").cast("long").alias("run_id"), "games_played", "wins", "avg_cpl"))
