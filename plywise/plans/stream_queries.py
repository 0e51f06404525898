"""Streaming views driven to completion over the supplied files."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plywise.functions.text import evaluation_key
from plywise.operators import summaries
from plywise.plans.board_queries import evaluations
from plywise.plans.fixtures import Fixtures, with_views
from plywise.plans.registry import query, rounded
from plywise.plans.sqltext import summary_sql
from plywise.session import shared_dir
from plywise.streaming import live


#: Games of a batch that are sent to every task, at most.
FEW_GAMES = 100_000


def _folders(fx: Fixtures, name: str) -> tuple[str, str]:
    root = f"{shared_dir(fx.spark)}/{name}-{uuid4().hex}"
    return f"{root}/table", f"{root}/progress"


def game_stream(fx: Fixtures) -> DataFrame:
    """Games as a stream over the order files."""
    orders = live.stream_files(fx.spark, fx.folder, fx.orders.schema, "orders*.parquet")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    result = F.when(priority == "5-LOW", "*").when(status == "F", "1-0").when(status == "O", "0-1").otherwise("1/2-1/2")
    return orders.select(
        F.col("o_orderkey").alias("game_id"), ((F.col("o_custkey") - F.col("o_custkey") % 2) % 50).cast("long").alias("run_id"),
        result.alias("result"), F.col("o_orderdate").alias("started_at"))


@query("live_newest_games", with_views(["games"], """
SELECT game_id, run_id, result FROM games ORDER BY started_at DESC, game_id DESC LIMIT 20"""))
def live_newest_games(fx: Fixtures) -> DataFrame:
    table, progress = _folders(fx, "newest")
    live.latest_games(game_stream(fx), table, progress, 20)
    return live.read_latest(fx.spark, table).select("game_id", "run_id", "result")


@query("live_captured_events", "SELECT event_type AS event_kind, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def live_captured_events(fx: Fixtures) -> DataFrame:
    table, progress = _folders(fx, "events")
    stream = live.stream_files(fx.spark, fx.folder, fx.events.schema, "events*.parquet")
    live.capture(stream.select("event_id", "event_type", "ts"), table, progress)
    latest = live.latest_state(fx.spark.read.parquet(table), "event_id", "ts")
    return latest.groupBy(F.col("event_type").alias("event_kind")).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("live_match_progress", with_views(["games", "runs"], """
SELECT run_id, games_requested, coalesce(games_started, 0) AS games_started, coalesce(games_completed, 0) AS games_completed,
  CASE WHEN coalesce(games_completed, 0) >= games_requested THEN 'completed' ELSE 'running' END AS status
FROM (SELECT run_id, run_id * 20 AS games_requested FROM runs) r
LEFT JOIN (SELECT run_id, count(*) AS games_started, count(*) FILTER (result <> '*') AS games_completed FROM games GROUP BY 1) g USING (run_id)"""))
def live_match_progress(fx: Fixtures) -> DataFrame:
    table, progress = _folders(fx, "progress")
    live.match_progress(game_stream(fx), table, progress)
    requested = fx.runs.select("run_id", (F.col("run_id") * 20).alias("games_requested"))
    return live.progress_status(live.progress_counts(live.read_latest(fx.spark, table)), requested)


@query("live_summary_rebuild", summary_sql("""
SELECT summary_id, run_id, games_played, wins, round(avg_cpl, 6) AS avg_cpl, attempt_count, total_tokens FROM summary"""))
def live_summary_rebuild(fx: Fixtures) -> DataFrame:
    table, progress = _folders(fx, "summaries")

    def summarize(runs: DataFrame) -> DataFrame:
        games = fx.games.join(runs, "run_id", "left_semi")
        return summaries.participant_summary(
            games, fx.participants, fx.runs, fx.prompts, fx.moves, evaluations(fx), fx.attempts, fx.token_usage, few_games=True)

    live.rebuild_summaries(game_stream(fx), summarize, table, progress)
    back = fx.spark.read.parquet(table)
    return rounded(back.select("summary_id", F.col("run_id").cast("long").alias("run_id"), "games_played", "wins", "avg_cpl",
                               "attempt_count", "total_tokens"))


def _by_runs(fx: Fixtures, name: str, facts: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Facts in one folder for each run, as a store of many runs keeps them."""
    path = f"{shared_dir(fx.spark)}/{name}-{uuid4().hex}"
    facts.join(ids, key).repartition("run_id").write.partitionBy("run_id").parquet(path)
    return fx.spark.read.parquet(path)


@query("live_summary_growth", summary_sql("""
SELECT summary_id, run_id, games_played, wins, losses, round(avg_cpl, 6) AS avg_cpl, blunders, attempt_count, illegal_attempts, total_tokens FROM summary"""))
def live_summary_growth(fx: Fixtures) -> DataFrame:
    """Every game lands twice, first as unfinished; facts lie in folders by run."""
    fx.number_lines()
    table, progress = _folders(fx, "totals")
    runs = fx.games.select("game_id", "run_id").where("run_id is not null")
    moves = _by_runs(fx, "moves", fx.moves.select(*summaries.MOVE_COLUMNS), runs, "game_id")
    attempts = _by_runs(fx, "attempts", fx.attempts.select(*summaries.ATTEMPT_COLUMNS), runs, "game_id")
    judged = _by_runs(fx, "evaluations", evaluations(fx).select("move_id", "centipawn_loss", "classification"), moves.select("move_id", "run_id"), "move_id")
    tokens = _by_runs(fx, "tokens", fx.token_usage.select("attempt_id", "total_tokens"), attempts.select("attempt_id", "run_id"), "attempt_id")
    games = fx.games.join(fx.runs.select("run_id"), "run_id", "left_semi").select(*summaries.GAME_COLUMNS, "started_at")
    landed = f"{shared_dir(fx.spark)}/landed-{uuid4().hex}"
    early = games.withColumn("result", F.lit("*")).withColumn("ended_at", F.col("started_at"))
    late = games.withColumn("ended_at", F.col("started_at") + F.expr("INTERVAL 1 HOUR"))
    for part in (early, late):
        part.coalesce(1).write.mode("append").parquet(landed)

    def measure(batch: DataFrame) -> DataFrame:
        touched = F.col("run_id").isin([r["run_id"] for r in batch.select("run_id").distinct().collect()])
        own = lambda facts: facts.where(touched).drop("run_id")
        # Facts of few games are picked; those of many are summed with the others of their runs, and meet their games then.
        few = batch.count() <= FEW_GAMES
        picked = lambda facts: facts.join(F.broadcast(batch.select("game_id")), "game_id", "left_semi") if few else facts
        return summaries.side_measures(batch, picked(own(moves)), own(judged), picked(own(attempts)), own(tokens))

    live.grow_summaries(live.stream_files(fx.spark, landed, late.schema, per_batch=1), measure, table, progress)
    totals = live.read_summary_totals(fx.spark, table)
    back = summaries.finished_summary(totals, fx.participants, fx.runs, fx.prompts)
    return rounded(back.select("summary_id", "run_id", "games_played", "wins", "losses", "avg_cpl", "blunders", "attempt_count", "illegal_attempts", "total_tokens"))


@query("live_cache_growth", """
SELECT 'p' || l_partkey || '-' || l_linenumber AS fen, 's' || l_suppkey AS uci, max(l_quantity) AS evaluation FROM lineitem
GROUP BY 1, 2 HAVING NOT bool_or(l_returnflag = 'A')""")
def live_cache_growth(fx: Fixtures) -> DataFrame:
    table, progress = _folders(fx, "cache")
    position = lambda df: df.select(
        F.concat_ws("-", F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.col("l_linenumber").cast("string")).alias("fen"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("uci"), "l_quantity", "l_returnflag")
    judged = position(fx.lineitem).groupBy("fen", "uci").agg(F.max("l_quantity").alias("evaluation"))
    seed = position(fx.lineitem).where("l_returnflag = 'A'").select("fen", "uci").distinct().join(judged, ["fen", "uci"]).select(
        evaluation_key(F.col("fen"), F.col("uci")).alias("key"), "fen", "uci", "evaluation")
    stream = position(live.stream_files(fx.spark, fx.folder, fx.lineitem.schema, "lineitem*.parquet")).select("fen", "uci")
    live.grow_cache(stream, seed, judged, table, progress)
    return live.read_grown(fx.spark, table).select("fen", "uci", "evaluation")
