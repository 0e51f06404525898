"""Orders made visible as ranks, pages and cuts by position, and sinks whose writes may be repeated."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plywise.operators import candidates, choices, datasets
from plywise.operators import summaries as ops
from plywise.operators.ordering import hash_order
from plywise.operators.selection import ranked
from plywise.plans.board_queries import _MODELS, models, summary
from plywise.plans.candidate_queries import CHOICE_CTES, labelled, labelled_sql
from plywise.plans.dataset_queries import _MIXED, mixed
from plywise.plans.fixtures import Fixtures, with_views
from plywise.plans.prediction_queries import _REWARD_LOG, _reuse_sql, log_heads, reward_log
from plywise.plans.registry import query, rounded, written
from plywise.plans.sqltext import summary_sql
from plywise.session import shared_dir
from plywise.sources import records
from plywise.sources.versions import Versioned, groups, replace_groups


def _folder(fx: Fixtures, name: str) -> str:
    return f"{shared_dir(fx.spark)}/{name}-{uuid4().hex}"


# Orders ---------------------------------------------------------------------------


@query("leaderboard_ranks", summary_sql("""
SELECT summary_id, row_number() OVER (ORDER BY run_id DESC, legality_mode, color, round(avg_cpl, 6) NULLS LAST, round(illegal_rate, 6), participant_id) AS place
FROM summary"""))
def leaderboard_ranks(fx: Fixtures) -> DataFrame:
    rows = rounded(ops.leaderboard(summary(fx), fx.participants).select("summary_id", "participant_id", "run_id", "legality_mode", "color", "avg_cpl", "illegal_rate"))
    return ranked(rows, [*ops.leaderboard_order(), F.col("participant_id")], "place").select("summary_id", "place")


@query("model_matrix_ranks", summary_sql("""
SELECT model_key, row_number() OVER (ORDER BY round(win_rate, 6) DESC, coalesce(round(avg_cpl, 6), 1e9), model_key) AS place FROM models""", {"models": _MODELS}))
def model_matrix_ranks(fx: Fixtures) -> DataFrame:
    return ranked(rounded(models(fx).select("model_key", "win_rate", "avg_cpl")), ops.model_order(), "place").select("model_key", "place")


@query("newest_game_ranks", with_views(["games"], "SELECT game_id, row_number() OVER (ORDER BY started_at DESC, game_id DESC) AS place FROM games"))
def newest_game_ranks(fx: Fixtures) -> DataFrame:
    return ranked(fx.games.select("game_id", "started_at"), ops.newest_order(), "place").select("game_id", "place")


@query("run_id_ranks", with_views(["games"], """
SELECT run_id, row_number() OVER (ORDER BY run_id DESC) AS place FROM (SELECT DISTINCT run_id FROM games WHERE run_id IS NOT NULL) r"""))
def run_id_ranks(fx: Fixtures) -> DataFrame:
    return ranked(ops.run_ids_desc(fx.games), [F.desc("run_id")], "place")


@query("mixed_row_ranks", f"""
SELECT fen, source, row_number() OVER (ORDER BY sha256(concat_ws('|', '4-mix', prompt, fen, completion, move, source)), fen, source) AS place FROM ({_MIXED}) m""")
def mixed_row_ranks(fx: Fixtures) -> DataFrame:
    rows = mixed(fx)
    return ranked(rows, [hash_order("4-mix", *[F.col(c) for c in rows.columns]), F.col("fen"), F.col("source")], "place").select("fen", "source", "place")


# Pages and cuts -------------------------------------------------------------------


@query("position_page_rest", labelled_sql("""
SELECT fen, origin FROM (SELECT fen, arg_min(origin, (s, seq)) AS origin, min((s, seq)) AS o FROM (
  SELECT fen_before AS fen, 'input' AS origin, 0 AS s, seq FROM labelled WHERE split = 'train'
  UNION ALL SELECT fen_before, 'arena_db', 1, move_id FROM moves) a GROUP BY 1) b ORDER BY o OFFSET 700""", views=("moves",)))
def position_page_rest(fx: Fixtures) -> DataFrame:
    return datasets.page_positions([
        datasets.position_records(labelled(fx), "train"),
        datasets.position_records(fx.moves.withColumn("seq", F.col("move_id")), None, "arena_db"),
    ], offset=700).select("fen", "origin")


@query("choice_rows_of_first_positions", labelled_sql("SELECT fen, target_move, candidate_count FROM choices ORDER BY position_seq LIMIT 700", CHOICE_CTES))
def choice_rows_of_first_positions(fx: Fixtures) -> DataFrame:
    return choices.choice_rows(labelled(fx), max_positions=700, with_prompt=False).select("fen", "target_move", "candidate_count")


@query("hash_sample_of_documents", "SELECT doc_id FROM documents ORDER BY sha256('11|' || doc_id), doc_id LIMIT (SELECT count(*) // 3 FROM documents)")
def hash_sample_of_documents(fx: Fixtures) -> DataFrame:
    return datasets.hash_sample(fx.documents.select("doc_id"), fx.documents.count() // 3, 11, "doc_id")


@query("accepted_specs_of_runs", with_views(["moves", "games"], """
SELECT fen_before, accepted_uci AS candidate_uci, move_id AS source_move_id FROM moves JOIN games USING (game_id) WHERE run_id IN (4, 10, 26)"""))
def accepted_specs_of_runs(fx: Fixtures) -> DataFrame:
    unjudged = fx.moves.select("move_id", F.lit(None).cast("string").alias("classification")).where("false")
    return candidates.accepted_specs(fx.moves, fx.games, unjudged, [4, 10, 26]).select("fen_before", "candidate_uci", "source_move_id")


# Files ----------------------------------------------------------------------------


@query("store_games", with_views(["games"], "SELECT game_id, run_id, white_participant_id, black_participant_id, result FROM games"))
def store_games(fx: Fixtures) -> DataFrame:
    """A store table, whose id has no name of its own, read back by its schema."""
    root = _folder(fx, "store")
    fx.games.select(F.col("game_id").alias("id"), "run_id", "white_participant_id", "black_participant_id", "result").write.parquet(f"{root}/games")
    return records.read_table(fx.spark, root, "games").select("game_id", "run_id", "white_participant_id", "black_participant_id", "result")


@query("prediction_files_in_order", with_views(["moves"], """
SELECT move_id, CASE WHEN l_linestatus = 'O' THEN 'open_file' ELSE 'closed_file' END AS gate_source, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS file_ord,
  row_number() OVER (PARTITION BY l_linestatus = 'O' ORDER BY move_id DESC) AS line FROM moves"""))
def prediction_files_in_order(fx: Fixtures) -> DataFrame:
    """Two folders of predictions, each written in an order that its names and rows keep."""
    root = _folder(fx, "predictions")
    for name, which in (("open_file", "l_linestatus = 'O'"), ("closed_file", "l_linestatus <> 'O'")):
        fx.moves.where(which).select("move_id").orderBy(F.desc("move_id")).write.json(f"{root}/{name}")
    back = records.read_prediction_files(fx.spark, [f"{root}/open_file", f"{root}/closed_file"], "move_id BIGINT")
    return ranked(back.where("file_ord = 0"), [F.col("line_ord")], "line").unionByName(ranked(back.where("file_ord = 1"), [F.col("line_ord")], "line")).select(
        "move_id", "gate_source", "file_ord", "line")


@query("metrics_file", with_views(["candidates"], """
SELECT '{"config":{"source":"all"},"metrics":{"positions":' || count(DISTINCT fen_before) || ',"rows":' || count(*) || '}}' AS value FROM candidates"""))
def metrics_file(fx: Fixtures) -> DataFrame:
    path = _folder(fx, "metrics")
    stats = fx.candidates.agg(F.count("*").alias("rows"), F.countDistinct("fen_before").alias("positions"))
    records.write_sidecar({"source": "all"}, stats, path, "metrics")
    return fx.spark.read.text(path)


@query("first_text_lines", "SELECT count(*) AS rows, CAST(sum(length(value)) AS BIGINT) AS chars FROM (SELECT 'd' || doc_id AS value FROM documents WHERE doc_id % 3 > 0 ORDER BY doc_id) x")
def first_text_lines(fx: Fixtures) -> DataFrame:
    """Lines of which a third are blank; the limit counts blank lines, too, and takes them all here."""
    path = _folder(fx, "lines")
    fx.documents.select(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).otherwise(" ").alias("value")).write.text(path)
    kept = records.first_lines(records.numbered_lines(fx.spark, path), fx.documents.count())
    return kept.agg(F.count("*").alias("rows"), F.sum(F.char_length("value")).alias("chars"))


@query("valid_rows", with_views(["candidates"], "SELECT seq, risk FROM (SELECT seq, 'good' AS risk FROM candidates) c"))
def valid_rows(fx: Fixtures) -> DataFrame:
    line = F.concat(F.lit('{"fen_before":"'), "fen_before", F.lit('","risk":"good","score":'), F.col("seq").cast("string"), F.lit("}"))
    rows = fx.candidates.select("seq", F.try_parse_json(line).alias("record"))
    checked = records.fail_on_reject(records.require_fields(rows, ["fen_before", "risk", "score"], ["score"]), "seq")
    return checked.select("seq", F.try_variant_get("record", "$.risk", "string").alias("risk"))


# Sinks ----------------------------------------------------------------------------


@query("summary_table_replace", summary_sql("SELECT summary_id, run_id, games_played, wins, round(avg_cpl, 6) AS avg_cpl FROM summary"))
def summary_table_replace(fx: Fixtures) -> DataFrame:
    """All summaries with wrong numbers for one run, then that run's replaced; readers see one table or the other."""
    table = Versioned(fx.spark, _folder(fx, "summaries"))
    rows = summary(fx).select("summary_id", "run_id", "games_played", "wins", "avg_cpl")
    table.replace(rows.withColumn("games_played", F.when(F.col("run_id") == 10, F.col("games_played") + 1).otherwise(F.col("games_played"))))
    replace_groups(rows.where("run_id = 10"), table, "run_id")
    return rounded(groups(table.rows(), "run_id"))


@query("reward_log_append", _reuse_sql(_REWARD_LOG))
def reward_log_append(fx: Fixtures) -> DataFrame:
    """The log of two jobs, the first of which is repeated after it had been written."""
    log = written(fx, reward_log(fx), "log")
    table = Versioned(fx.spark, _folder(fx, "rewards"))
    for number, part in ((0, 0), (1, 1), (0, 0), (1, 1)):
        table.append(log.where(F.pmod(F.xxhash64("batch"), F.lit(2)) == part), number)
    return log_heads(table.rows().drop("part"))
