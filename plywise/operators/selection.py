"""Rows by their place in a global order, without sorting them in one task.

The row at a place is found in rounds: keys that are drawn evenly by hash part the open range into intervals, the rows
of each are counted, and the interval that holds the place is the next range, until few keys are left. A round reads the
narrow table of keys once for the draw and once for the counts; the driver sees a bounded number of keys and counts.
What is wanted is then a filter on the order, so wide rows are neither sorted nor exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from plywise.session import stored

#: Keys that part a range, and keys that are looked at one by one.
PIVOTS, FEW = 64, 16_384


class Place(NamedTuple):
    """The key at a place of the order: its value, how many rows stand before it, and how many have it."""

    key: Column
    before: int
    rows: int


def order_key(order: Sequence[Column | str]) -> Column:
    """One comparable column of an order, NULL first."""
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])


def _literal(value: Any, kind: DataType) -> Column:
    if isinstance(kind, StructType) and value is not None:
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
    return F.lit(value).cast(kind)


def _interval(key: Column, pivots: list[Column], low: int = 0, high: int | None = None) -> Column:
    """2 i + 1 for the i-th pivot itself, 2 i for what lies before it and after the one before; by bisection."""
    high = len(pivots) if high is None else high
    if low == high:
        return F.lit(2 * low)
    middle = (low + high) // 2
    return (F.when(key == pivots[middle], 2 * middle + 1).when(key < pivots[middle], _interval(key, pivots, low, middle))
            .otherwise(_interval(key, pivots, middle + 1, high)))


def place(keys: DataFrame, n: int) -> Place | None:
    """The key of the n-th row (from 1) of ``keys(key)``, or None where there are fewer rows."""
    kind, before, rows = keys.schema["key"].dataType, 0, keys.count()
    if n < 1 or n > rows:
        return None
    part, turn = keys, 0
    while rows > FEW:
        drawn = part.groupBy(F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(PIVOTS))).agg(F.min_by("key", F.xxhash64("key", F.lit(turn + 1))).alias("key"))
        pivots = [_literal(r["key"], kind) for r in drawn.orderBy("key").collect()]
        counts = {r["at"]: r["count"] for r in part.select(_interval(F.col("key"), pivots).alias("at")).groupBy("at").count().collect()}
        for at in sorted(counts):
            if before + counts[at] >= n:
                break
            before += counts[at]
        rows, i, turn = counts[at], at // 2, turn + 2
        if at % 2:
            return Place(pivots[i], before, rows)
        if i > 0:
            part = part.where(F.col("key") > pivots[i - 1])
        if i < len(pivots):
            part = part.where(F.col("key") < pivots[i])
    for r in part.groupBy("key").count().orderBy("key").collect():
        if before + r["count"] >= n:
            return Place(_literal(r["key"], kind), before, r["count"])
        before += r["count"]
    raise AssertionError("the table of keys has changed")


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int | None, offset: int = 0, descending: bool = False) -> DataFrame:
    """The ``n`` rows (all, if None) after the first ``offset`` in this order, in no particular order themselves.

    ``order`` should tell rows apart; of rows alike in it that stand on an edge, any are taken. ``descending`` turns the
    whole order round, NULL last. Runs the rounds when called.
    """
    if offset <= 0 and n is None:
        return df
    key = order_key(order)
    keys = stored(df.select(key.alias("key")), "keys")
    total = keys.count()
    first, last = max(offset, 0), total if n is None else min(total, max(offset, 0) + max(n, 0))
    if descending:
        first, last = total - last, total - first
    if first >= last:
        return df.where(F.lit(False))
    keep, edges = F.lit(True), {}
    if first > 0:
        low = place(keys, first + 1)
        keep, edges[low.before] = key > low.key, low
    if last < total:
        high = place(keys, last)
        keep, edges[high.before] = keep & (key < high.key), high
    taken = lambda at: min(last, at.before + at.rows) - max(first, at.before)
    for at in edges.values():
        if taken(at) == at.rows:
            keep = keep | (key == at.key)
    out = df.where(keep)
    for at in edges.values():
        if taken(at) < at.rows:  # rows alike in the whole order
            out = out.unionByName(df.where(key == at.key).limit(taken(at)))
    return out


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank", rows_each: int = 1_000_000) -> DataFrame:
    """All rows with their place (from 1) in a global order.

    Rows are dealt by ranges of the order, counted by range, and numbered inside their range, so a task sees one range
    and one task the ranges' counts. The rows are counted, sampled for the ranges and dealt, so they are written before; the
    ranges are drawn from a sample, so they are written, too, before they are counted.
    """
    df = stored(df, "rows")
    total = df.count()
    n = max(1, -(-total // rows_each))
    placed = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_inside", inside).join(starts, "_part").withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop(
        "_part", "_inside", "_start")
