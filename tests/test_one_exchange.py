"""Rows that meet by position are exchanged once, tables that are read again are narrow; hot positions give the same rows."""

from functools import partial

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from plywise.operators import candidates, choices, datasets, evaluation
from plywise.operators.ordering import by_key, counters, frequent, split_lookup
from plywise.plans.fixtures import Fixtures
from plywise.plans import candidate_queries
from plywise.sources.versions import Versioned
from plywise.streaming import live


def exchanges(df):
    """Shuffles of the plan, with broadcasts off."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in f" {line}" and "hashpartitioning" in line]


@pytest.fixture
def no_broadcasts(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture
def rows(spark):
    """Positions with many and few moves, repeated rows, losses that are alike or NULL, a position that is NULL."""
    i = F.col("id")
    fen = F.when(i % 3 == 0, "hot").when(i % 101 == 5, F.lit(None)).otherwise(F.concat(F.lit("f"), (i % 37).cast("string")))
    cpl = F.when(i % 11 != 0, (i * 37) % 500).cast("int")
    return spark.range(900).select(
        fen.alias("fen_before"), F.concat(F.lit("m"), (i % 29).cast("string")).alias("candidate_uci"), F.concat(F.lit("M"), (i % 29).cast("string")).alias("candidate_san"),
        F.when(i % 2 == 0, "white").otherwise("black").alias("side_to_move"), F.lit("s").alias("source"),
        F.when(cpl < 150, "good").otherwise("blunder").alias("risk"), (100 - F.coalesce(cpl, F.lit(50)) / 5).cast("int").alias("score"), cpl.alias("centipawn_loss"),
        F.when(i % 4 == 0, (i % 5)).cast("int").alias("candidate_rank_in_generator"), i.alias("seq"))


def content(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("cap", [None, 3])
def test_lists_of_positions_take_one_exchange_and_hot_ones_are_alike(spark, rows, monkeypatch, no_broadcasts, cap):
    lists = choices.position_lists(rows, cap)
    assert len(exchanges(lists)) == 1
    whole = content(choices.choice_rows(rows, max_candidates=cap, with_prompt=False))
    drops = content(choices.choice_drops(rows, 2, cap, True))
    assert content(choices.drops_of(choices.position_lists(rows, cap), 2, cap, True)) == drops
    monkeypatch.setattr(choices, "by_key", partial(by_key, least=50))
    assert content(choices.choice_rows(rows, max_candidates=cap, with_prompt=False)) == whole
    assert content(choices.choice_drops(rows, 2, cap, True)) == drops and len(whole) > 20


def test_pairs_take_one_exchange_and_hot_positions_are_alike(spark, rows, monkeypatch, no_broadcasts):
    pairs = choices.candidate_pairs(rows, 4)
    assert len({line.split("hashpartitioning")[1].split(",")[0].split("#")[0] for line in exchanges(pairs)}) == 1
    whole = content(choices.pair_rows(rows, 4, with_prompt=False))
    monkeypatch.setattr(choices, "by_key", partial(by_key, least=50))
    assert content(choices.pair_rows(rows, 4, with_prompt=False)) == whole and len(whole) > 50


def test_choices_leave_fields_out_that_nobody_asks_for(spark, rows):
    fields = ("uci", "san", "risk", "score", "centipawn_loss", "candidate_rank_in_generator")
    every, some = choices.choice_rows(rows), choices.choice_rows(rows, fields=fields)
    assert some.select("candidates").schema["candidates"].dataType.elementType.names == list(fields)
    same = [c for c in every.columns if c != "candidates"]
    assert content(some.select(same)) == content(every.select(same))


def test_counters_count_lists_in_the_same_pass(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("a", None), (None, ["x"])], "k string, l array<string>")
    counted = counters(df, {"k": F.col("k")}, {"l": F.col("l")})
    assert sorted(map(tuple, counted.collect())) == [("k", "a", 2), ("k", "b", 1), ("l", "x", 2), ("l", "y", 1)]
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0


def counting(spark, df, column):
    seen = spark.sparkContext.accumulator(0)

    def touch(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(touch, LongType()).asNondeterministic()(F.col(column))), seen


def test_hard_cases_compute_their_rows_once(spark):
    df, seen = counting(spark, spark.range(400).select(F.col("id").alias("example_index"), (F.col("id") % 7).alias("severity"), F.array(F.lit("x")).alias("categories")), "severity")
    found = evaluation.hard_cases(df, 5).collect()
    assert sorted((r.severity, r.example_index) for r in found) == [(6, 6), (6, 13), (6, 20), (6, 27), (6, 34)] and seen.value == 400


def test_several_tables_are_looked_up_in_one_exchange(spark, no_broadcasts):
    proposals = spark.range(300).select(F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 9).cast("string")).alias("fen"), (F.col("id") % 4).cast("string").alias("move"), "id")
    one = spark.createDataFrame([("hot", "0", 1), ("1", "1", 2)], "fen string, move string, a int")
    two = spark.createDataFrame([("hot", "2", 3), ("1", "1", 4)], "fen string, move string, b int")
    plain = proposals.join(one, ["fen", "move"], "left").join(two, ["fen", "move"], "left")
    keys = ["fen", "move"]
    even = split_lookup(proposals, [one, two], keys, frequent(proposals, keys))
    assert len(exchanges(even)) == 3 and content(even) == content(plain)
    assert content(split_lookup(proposals, [one, two], keys, frequent(proposals, keys, 20), least=20)) == content(plain)


def test_rewards_look_proposals_up_in_one_exchange(spark, no_broadcasts):
    make = spark.createDataFrame
    proposals = make([(0, 1, "f", "a", True), (0, 2, "f", "b", True), (0, 3, "f", "c", True), (1, 4, "f", "zz", True), (1, 5, "g", None, False), (1, 6, None, "a", True), (1, 7, "g", "d", True)],
                     "batch long, idx long, fen string, parsed_move string, parse_ok boolean")
    legal = make([("f", "a"), ("f", "b"), ("f", "c"), ("g", "d")], "fen string, uci string")
    judged = make([("f", "a", 30, "good", "b"), ("f", "b", 9, "best", "b"), ("f", "c", 400, "blunder", "b"), ("g", "d", None, "mate_missed", "d")],
                  "fen string, uci string, centipawn_loss int, classification string, best_move_uci string")
    counts = frequent(proposals, ["fen", "parsed_move"])
    checked = evaluation.with_legality(proposals, legal, counts=counts)
    scored = evaluation.reward_samples(checked, judged.where("uci = 'a'"), make([("f", "b")], "fen string, best string"), judged, counts=counts)
    assert sum("fen#" in x and "idx" not in x for x in exchanges(scored)) == 5  # proposals, legal moves, known, judged, best
    found = {r.idx: (r.classification, r.centipawn_loss, r.best_move_uci, round(r.reward, 3), r.cache_hit, r.evaluated) for r in scored.collect()}
    assert found == {1: ("good", 30, "b", 0.9, True, False), 2: ("best", 0, "b", 1.0, True, False), 3: ("blunder", 400, "b", 0.0, False, True),
                     4: ("illegal", None, None, -0.5, False, False), 5: ("malformed", None, None, -1.0, False, False),
                     6: ("illegal", None, None, -0.5, False, False), 7: ("mate_missed", None, "d", 1.0, False, True)}


def test_heads_of_a_log_are_found_by_numbers_alone(spark):
    samples = spark.range(200).select((F.col("id") % 3).alias("batch"), F.when(F.col("id") > 2, F.col("id")).alias("idx"), *[F.lit(1.0).alias(c) for c in ("reward",)],
                                      F.lit(True).alias("parse_ok"), F.lit(True).alias("legal_ok"), F.col("id").cast("string").alias("parsed_move"), F.lit(1).alias("centipawn_loss"),
                                      F.lit("b").alias("best_move_uci"), F.lit("best").alias("classification"))
    stats = samples.groupBy("batch").agg(F.count("*").alias("examples"))
    log = evaluation.reward_log(samples, stats, 3)
    moves = F.from_json("value", "samples ARRAY<STRUCT<parsed_move: STRING>>")["samples"]["parsed_move"]
    assert {r[0]: r[1] for r in log.select("batch", moves).collect()} == {0: ["0", "3", "6"], 1: ["1", "4", "7"], 2: ["2", "5", "8"]}
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("Window") and "WindowGroupLimit" not in plan.split("LeftSemi")[1]


def test_error_stats_compute_errors_once(spark):
    order = F.struct("kind", "id")
    errors = spark.range(60).select("id", (F.col("id") % 2).alias("kind"), (F.col("id") % 20).cast("string").alias("fen"), F.when(F.col("id") % 7 > 0, "long prompt").alias("prompt"),
                                    F.lit("b").alias("best_move_uci"), F.when(F.col("id") % 5 == 0, "b").otherwise("c").alias("accepted_uci"), F.lit(9).alias("centipawn_loss"),
                                    F.lit("blunder").alias("classification"), F.lit(4).alias("run_id"), F.lit(1).alias("game_id"), F.lit(2).alias("move_id"), F.lit(3).alias("ply"))
    df, seen = counting(spark, errors, "id")
    stats = {(r.metric, r.key): r.n for r in datasets.error_stats(df.withColumn("error_order", order), 5).collect()}
    assert seen.value == 60 and stats["written", ""] == 5 and stats["by_run", "4"] == 5
    usable = sorted((i % 2, i) for i in range(60) if i % 7 and i % 5)
    edge = [x for n, x in enumerate(usable) if x[1] % 20 not in {y[1] % 20 for y in usable[:n]}][4]
    assert stats["candidates", ""] == sum((i % 2, i) <= edge for i in range(60))


def test_lines_are_written_as_they_lie_by_game(spark, tmp_path, no_broadcasts):
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate long"
    lines = [(g, 10 * g + k, k, 3 - k, 5.0, 1.0 * k, 0.05, 0.02, "A", "F", 0) for g in (1, 2, 3) for k in (1, 2)] + [(None, 7, 1, 1, 5.0, 1.0, 0.05, 0.02, "N", "O", 0)]
    spark.createDataFrame(lines, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    fx = Fixtures(spark, str(tmp_path))
    before = content(fx.moves.drop("l_shipdate"))
    fx.number_lines()
    assert content(fx.moves) == before
    games = spark.createDataFrame([(1, 5), (3, 6)], "game_id long, run_id long")
    assert len(exchanges(fx.moves.join(games, "game_id"))) == 1


def test_specs_of_a_position_lie_in_one_place_and_hot_positions_are_alike(spark, monkeypatch, tmp_path, no_broadcasts):
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate long"
    lines = [(g, 1 if g % 3 == 0 else g % 8, g % 13, 1 + k, 3.0 + g % 9, 1.0 * k, 0.05, 0.02, "ANR"[g % 3 - k], "FO"[k], 0) for g in range(1, 80) for k in (0, 1)]
    spark.createDataFrame(lines, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(g, g % 5, "F", 1.0, 0, "1-URGENT") for g in range(1, 80)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate long, o_orderpriority string").withColumn(
        "o_orderdate", F.timestamp_seconds("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    queries = {name: getattr(candidate_queries, name) for name in ("unique_candidate_specs", "candidate_rows_capped", "candidate_build_counts", "first_seen_positions")}
    even = {name: run(Fixtures(spark, str(tmp_path))) for name, run in queries.items()}
    plan = exchanges(even["unique_candidate_specs"])
    assert not any("fen_before#" in x and "candidate_uci#" in x.split("hashpartitioning")[1].split("]")[0] for x in plan)
    even = {name: content(df) for name, df in even.items()}
    monkeypatch.setattr(candidate_queries, "frequent", partial(frequent, least=40))
    for name, run in queries.items():
        assert content(run(Fixtures(spark, str(tmp_path)))) == even[name] and even[name]


def test_chosen_positions_are_few_rows_of_known_size(spark):
    specs = spark.range(300).select((F.col("id") % 50).cast("string").alias("fen_before"), F.col("id").alias("seq"), F.struct("id").alias("spec_order"))
    chosen = candidates.choose_positions(specs, 3)
    assert "BroadcastExchange" in chosen._jdf.queryExecution().executedPlan().toString() and sorted(r.seq % 50 for r in chosen.collect()) == sorted([0, 1, 2] * 6)


def test_the_cache_exchanges_no_keys_and_keeps_the_last_of_a_key(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(live, "stored", lambda df, name="table": written.append((name, df.columns)) or df)
    key = lambda df: df.withColumn("key", live.evaluation_key(F.col("fen"), F.col("uci")))
    judged = spark.range(40).select(F.col("id").cast("string").alias("fen"), F.lit("u").alias("uci"), F.col("id").alias("evaluation"))
    spark.range(60).select((F.col("id") % 45).cast("string").alias("fen"), F.lit("u").alias("uci")).write.parquet(f"{tmp_path}/landed")
    seed = key(judged.where("evaluation < 10")).select("key", "fen", "uci", "evaluation")
    stream = live.stream_files(spark, f"{tmp_path}/landed", judged.select("fen", "uci").schema, per_batch=1)
    live.grow_cache(stream, seed, judged, f"{tmp_path}/cache", f"{tmp_path}/progress")
    assert ("requests", ["fen", "uci", "bucket"]) in written
    assert sorted(r.evaluation for r in live.read_grown(spark, f"{tmp_path}/cache").collect()) == list(range(10, 40))
    again = key(spark.createDataFrame([("12", "u", 99), ("13", "u", 98)], "fen string, uci string, evaluation long")).select("key", "fen", "uci", "evaluation", F.lit(0).alias("bucket"))
    Versioned(spark, f"{tmp_path}/cache/grown", ("bucket",)).append(again, 100)
    want = sorted({**{str(i): i for i in range(10, 40)}, "12": 99, "13": 98}.items())
    assert sorted((r.fen, r.evaluation) for r in live.read_grown(spark, f"{tmp_path}/cache").collect()) == want
    monkeypatch.setattr(live, "FEW", 1)
    assert sorted((r.fen, r.evaluation) for r in live.read_grown(spark, f"{tmp_path}/cache").collect()) == want
