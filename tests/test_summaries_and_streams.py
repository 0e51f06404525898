import uuid

from pyspark.sql import functions as F

from plywise.operators import games as game_ops
from plywise.operators import summaries
from plywise.streaming import live


def store(spark, n_games=20, result="*", reason="max_plies"):
    make = spark.createDataFrame
    games = make([(g, 1, 1 if g % 2 else 2, 2 if g % 2 else 1, result, reason) for g in range(1, n_games + 1)],
                 "game_id long, run_id long, white_participant_id long, black_participant_id long, result string, termination_reason string")
    people = make([(1, 1, None, "model", "a"), (2, 1, 5, "random", "b")], "participant_id long, run_id long, model_snapshot_id long, opponent_type string, display_name string")
    runs = make([(1, None, 7)], "run_id long, prompt_id long, opening_suite_id long").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    prompts = make([], "prompt_id long, mode string, legality_mode string")
    moves = make([(g * 10, g, 1, "white", 1, 4.0) for g in range(1, n_games + 1)], "move_id long, game_id long, ply int, color string, retries_used int, latency_total_ms double")
    evals = make([(10, "best", 10), (10, "blunder", None)], "move_id long, classification string, centipawn_loss int")
    attempts = make([(g * 100 + n, g, 1, n == 2, n == 2) for g in range(1, n_games + 1) for n in (1, 2)], "attempt_id long, game_id long, ply int, parse_ok boolean, legal_ok boolean")
    tokens = make([(102, 50)], "attempt_id long, total_tokens int")
    return games, people, runs, prompts, moves, evals, attempts, tokens


def test_summary_invariants(spark):
    out = summaries.participant_summary(*store(spark)).collect()
    assert len(out) == 4 and sum(r.games_played for r in out) == 40
    assert all(r.games_played == 10 and r.unfinished == 10 and r.avg_game_plies == 1.0 and not r.low_sample for r in out)
    white = next(r for r in out if r.participant_id == 1 and r.color == "white")
    assert (white.mode, white.legality_mode, white.evaluated_move_count, white.avg_cpl, white.accuracy_rate) == ("strict", "open", 2, 10.0, 0.5)
    assert (white.attempt_count, white.malformed_attempts, white.illegal_attempts, white.total_tokens) == (20, 10, 0, 50)
    black = next(r for r in out if r.color == "black")
    assert black.avg_cpl is None and black.avg_latency_ms == 0.0 and black.attempt_count == 0


def test_forfeit_counts_for_the_loser_only(spark):
    out = {r.color: r for r in summaries.participant_summary(*store(spark, 1, "0-1", "forfeit_invalid")).collect()}
    assert (out["white"].losses, out["white"].forfeit_invalid_count, out["black"].wins, out["black"].forfeit_invalid_count) == (1, 1, 1, 0)


def test_model_comparison_never_mixes_legality(spark):
    tables = store(spark)
    snaps = spark.createDataFrame([(5, "q4", 10, None, "r")], "model_snapshot_id long, quantization string, context_window int, sampler_params string, runtime_version string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    s = summaries.participant_summary(*tables)
    rows = summaries.model_comparison(s, tables[1], tables[2], snaps).collect()
    assert {r.model_key for r in rows} == {"name:a|open", "snap:5|open"} and all(r.games_played == 20 for r in rows)
    assert summaries.model_comparison(s, tables[1], tables[2], snaps, legality_mode="constrained").count() == 0
    assert {r.participant for r in summaries.leaderboard(s, tables[1], color="white").collect()} == {"a", "b"}


def test_retries(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, False, "malformed_json", None, 2.0), (2, 1, 1, 2, False, "illegal_move", "zz", 3.0), (3, 1, 1, 3, True, None, "e2e4", 4.0)],
                               "attempt_id long, game_id long, ply int, attempt_number int, legal_ok boolean, error_type string, parsed_move string, latency_ms double")
    out = game_ops.accepted_from_attempts(df).first()
    assert (out.retries_used, out.latency_total_ms) == (2, 9.0)
    assert [r.feedback_error for r in game_ops.retry_features(df, 2).orderBy("attempt_number").collect()] == [None, "malformed_json", "illegal_move"]


def test_streams_over_several_batches_equal_batch(spark, tmp_path):
    games = spark.range(200).select(F.col("id").alias("game_id"), (F.col("id") % 3).alias("run_id"), F.when(F.col("id") % 4 == 0, "*").otherwise("1-0").alias("result"),
                                    (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(F.col("id") * 37 % 200).cast("int"))).alias("started_at"))
    folder = str(tmp_path / "landed")
    games.repartition(5).write.parquet(folder)
    stream = lambda: live.stream_files(spark, folder, games.schema, per_batch=2)
    new = lambda: (str(tmp_path / uuid.uuid4().hex), str(tmp_path / uuid.uuid4().hex))
    table, progress = new()
    live.latest_games(stream(), table, progress, 20)
    expected = [r.game_id for r in summaries.newest_games(games, 20).collect()]
    assert sorted(r.game_id for r in live.read_latest(spark, table).collect()) == sorted(expected)
    table, progress = new()
    live.match_progress(stream(), table, progress)
    counts = {r.run_id: (r.games_started, r.games_completed) for r in live.progress_counts(live.read_latest(spark, table)).collect()}
    batch = {r.run_id: (r.n, r.done) for r in games.groupBy("run_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("result") != "*", 1)).alias("done")).collect()}
    assert counts == batch
    table, progress = new()
    live.capture(stream(), table, progress)
    live.capture(stream(), table, progress)
    assert spark.read.parquet(table).count() == 200
    table, progress = new()
    live.rebuild_summaries(stream(), lambda runs: games.join(runs, "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("n")), table, progress)
    assert {r.run_id: r.n for r in spark.read.parquet(table).collect()} == {k: v[0] for k, v in batch.items()}


def test_cache_grows_over_batches(spark, tmp_path):
    from plywise.functions.text import evaluation_key

    requests = spark.range(90).select(F.concat(F.lit("f"), (F.col("id") % 30).cast("string")).alias("fen"), F.lit("u").alias("uci"))
    folder, table, progress = (str(tmp_path / n) for n in ("requests", "cache", "progress"))
    requests.repartition(4).write.parquet(folder)
    judged = requests.distinct().withColumn("evaluation", F.length("fen"))
    seed = judged.where("fen = 'f3'").select(evaluation_key(F.col("fen"), F.col("uci")).alias("key"), "fen", "uci", "evaluation")
    live.grow_cache(live.stream_files(spark, folder, requests.schema, per_batch=1), seed, judged, table, progress)
    grown = live.read_grown(spark, table)
    assert grown.count() == grown.select("key").distinct().count() == 29


def test_updated_game_is_counted_once(spark, tmp_path):
    rows = lambda result: spark.createDataFrame([(1, 7, result), (2, 7, "*")], "game_id long, run_id long, result string")
    folder, table, progress = (str(tmp_path / n) for n in ("landed", "states", "progress"))
    for result in ("*", "1-0"):
        rows(result).coalesce(1).write.mode("append").parquet(folder)
    live.match_progress(live.stream_files(spark, folder, rows("*").schema, per_batch=1), table, progress)
    counts = live.progress_counts(live.read_latest(spark, table)).collect()
    assert [(r.run_id, r.games_started, r.games_completed) for r in counts] == [(7, 2, 1)]


def test_view_goes_on_with_a_trigger(spark, tmp_path):
    row = lambda i, result: spark.createDataFrame([(i, 7, result)], "game_id long, run_id long, result string").coalesce(1)
    folder, table, progress = (str(tmp_path / n) for n in ("landed", "states", "progress"))
    row(1, "*").write.parquet(folder)
    stream = live.stream_files(spark, folder, row(1, "*").schema)
    query = live.match_progress(stream, table, progress, {"processingTime": "200 milliseconds"})
    try:
        query.processAllAvailable()
        row(1, "1-0").write.mode("append").parquet(folder)
        row(2, "*").write.mode("append").parquet(folder)
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    counts = live.progress_counts(live.read_latest(spark, table)).collect()
    assert [(r.games_started, r.games_completed) for r in counts] == [(2, 1)]
