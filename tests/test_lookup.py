import random

from pyspark.sql import functions as F

from plywise.functions import labels
from plywise.operators import candidates, evaluation
from plywise.operators.ordering import split_lookup


def test_a_hot_key_is_split(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 50}", i) for i in range(500)] + [(None, 1), ("unknown", 2)] + [("gone", i) for i in range(900)]
    table = [("hot", 1.0), *((f"k{i}", float(i)) for i in range(50)), (None, 9.0)]
    found = split_lookup(spark.createDataFrame(rows, "k string, i int"), spark.createDataFrame(table, "k string, v double"), ["k"], least=100, parts=16)
    known = {k: v for k, v in table if k is not None}
    assert sorted(map(str, map(tuple, found.select("k", "i", "v").collect()))) == sorted(str((k, i, known.get(k))) for k, i in rows)


def test_tasks_are_even_without_skew_handling(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
        table = rows.distinct().withColumn("v", F.length("k"))
        sizes = split_lookup(rows, table, ["k"], least=1000).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 1.6 * 60_000 / len(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_legality_of_a_hot_position(spark):
    rows = [(i, "start", "e2e4" if i % 2 else "E2e5 ") for i in range(400)] + [(400, "other", "a1a2"), (401, None, "e2e4"), (402, "start", None)]
    legal = spark.createDataFrame([("start", "e2e4"), ("start", "e2e4"), ("other", "a1a2"), ("start", "e2e5")], "fen string, uci string")
    frame = spark.createDataFrame(rows, "i int, fen string, parsed_move string")
    for normalize in (False, True):
        found = evaluation.with_legality(frame, legal, normalize=normalize)
        assert found.columns == ["i", "fen", "parsed_move", "legal_ok"] and found.count() == len(rows)
        assert {r["i"] for r in found.where("legal_ok").collect()} == {i for i in range(401) if normalize or i % 2 or i == 400}


def test_counters_of_a_build(spark):
    rng = random.Random(1)
    specs = [(f"p{rng.randrange(6)}", f"m{rng.randrange(8)}", rng.choice(["arena_move", "stockfish_good"]), i) for i in range(300)]
    legal = {(f"p{p}", f"m{m}") for p in range(6) for m in range(5)}
    judged = {k: (rng.choice(["good", "blunder"]), rng.randrange(400)) for k in sorted(legal)[:25]}
    frame = spark.createDataFrame(specs, "fen_before string, candidate_uci string, source string, o int").withColumn("spec_order", F.struct("o"))
    moves = spark.createDataFrame(sorted(legal), "fen string, uci string")
    marks = spark.createDataFrame([(*k, *v) for k, v in judged.items()], "fen_before string, candidate_uci string, classification string, centipawn_loss int")
    risk = {(r["fen_before"], r["candidate_uci"]): r["risk"] for r in marks.withColumn("risk", labels.risk(F.col("classification"), F.col("centipawn_loss"))).collect()}
    for limit in (None, 3):
        got = {(r["metric"], r["key"]): r["n"] for r in candidates.build_counts(frame, moves, marks, limit).collect()}
        first = {}
        for fen, uci, source, _ in specs:
            first.setdefault((fen, uci), source)
        unique = [k for k in first if k in legal]
        kept = [k for i, k in enumerate(unique) if limit is None or sum(x[0] == k[0] for x in unique[:i]) < limit]
        want = {("candidates_seen", ""): 300, ("dropped_illegal_candidate", ""): sum(s[:2] not in legal for s in specs),
                ("dropped_duplicate_candidate", ""): sum(s[:2] in legal for s in specs) - len(unique), ("dropped_candidate_limit", ""): len(unique) - len(kept),
                ("positions_seen", ""): len({k[0] for k in unique}), ("rows_written", ""): len(kept)}
        for k in kept:
            if k in risk:
                for name in (("by_source", first[k]), ("by_risk", risk[k])):
                    want[name] = want.get(name, 0) + 1
        assert {k: v for k, v in got.items() if k[0] != "by_split"} == want
        assert sum(v for k, v in got.items() if k[0] == "by_split") == sum(k in risk for k in kept)
    none = candidates.build_counts(frame.where("false"), moves, marks)
    assert {r["n"] for r in none.collect()} == {0} and none.count() == 6
