import random

import pytest
from pyspark.sql import functions as F

from plywise.operators import selection
from plywise.operators.selection import first_rows, ranked


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(selection, "FEW", 10)
    monkeypatch.setattr(selection, "PIVOTS", 5)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([None, "a", "b", "ß"]), rng.choice([None, 0, -3, 7]), i, "x" * (i % 5)) for i in rng.sample(range(10 * n), n)]


def in_order(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", first(r[1]), r[2]))


@pytest.mark.parametrize("n, offset", [(0, 0), (1, 0), (37, 0), (400, 0), (999, 0), (None, 0), (50, 100), (None, 350), (5, 399), (5, 400)])
@pytest.mark.parametrize("descending", [False, True])
def test_rows_at_places(spark, n, offset, descending):
    rows = rows_of(400)
    frame = spark.createDataFrame(rows, "a string, b int, i long, wide string").repartition(7)
    found = first_rows(frame, ["a", "b", F.col("i")], n, offset, descending)
    ordered = in_order(rows)[:: -1 if descending else 1]
    assert sorted(found.collect(), key=str) == sorted(ordered[offset:][:n], key=str)


def test_plan_has_no_single_task(spark):
    frame = spark.range(1000).withColumn("wide", F.repeat(F.lit("x"), 100))
    plan = first_rows(frame, [F.xxhash64("id"), "id"], 700)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("SinglePartition", "Limit", "TakeOrdered", "Sort", "Exchange"))


def test_rows_alike_in_the_order(spark):
    frame = spark.range(300).select((F.col("id") % 3).alias("k"), F.struct(F.lit(None).cast("string").alias("s"), F.col("id").alias("j")).alias("nested"))
    found = first_rows(frame, ["k"], 130).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in found} == {0: 100, 1: 30}
    found = first_rows(frame, ["k"], 20, 90).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in found} == {0: 10, 1: 10}
    assert first_rows(frame, ["k", "nested"], 101).where("k = 1").first()["nested"]["j"] == 1


def test_ranks(spark):
    rows = rows_of(300)
    frame = spark.createDataFrame(rows, "a string, b int, i long, wide string").repartition(5)
    found = ranked(frame, [F.col("a"), F.col("b").asc_nulls_first(), F.col("i")], "place", rows_each=40)
    assert [tuple(r)[:4] for r in sorted(found.collect(), key=lambda r: r["place"])] == in_order(rows)
    assert found.agg(F.min("place"), F.max("place"), F.countDistinct("place")).first() == (1, 300, 300)


def test_nothing(spark):
    empty = spark.createDataFrame([], "k long")
    assert first_rows(empty, ["k"], 5).count() == 0 and ranked(empty, [F.col("k")]).count() == 0
