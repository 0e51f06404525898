"""Order-dependent building blocks that stay distributed when one key holds most rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plywise.operators.selection import first_rows
from plywise.session import stored

#: Keys of a look-up that are split, at most; they and their rows of the table go to every task.
HEAVY = 1000
#: Buckets in which keys are counted before they are counted one by one.
BUCKETS = 1 << 18


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key. An aggregate, so a hot key is reduced before the shuffle."""
    return _pick(df, keys, F.min, F.min_by, order)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, F.max, F.max_by, order)


def _pick(df: DataFrame, keys: Sequence[str], extreme, extreme_by, order: Sequence[str]) -> DataFrame:
    """The order stands in front of the other columns, so a row is exchanged with its order once, not twice; rows with maps
    or variants, which have no order, go beside it."""
    leading = [c for c in order if c not in keys]
    others = leading + [c for c in df.columns if c not in keys and c not in leading]
    row = F.struct(*others)
    ordered = not any(kind in df.schema[c].dataType.simpleString() for c in others for kind in ("map<", "variant"))
    picked = df.groupBy(*keys).agg((extreme(row) if ordered else extreme_by(row, F.struct(*order))).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in others]).select(*df.columns)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """The k best rows of every group; ranked per task before the shuffle (group limit)."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return top if rank else top.drop(name)


def split_lookup(
    rows: DataFrame, table: DataFrame | Sequence[DataFrame], keys: Sequence[str], counts: DataFrame | None = None, least: int = 10_000, parts: int = 64
) -> DataFrame:
    """``rows`` with the columns of ``table`` (or of several), whose keys are unique; NULL where a key is not in it.

    Keys are counted first, when called; as this reads the rows, too, they are written once. Those with more than ``least`` rows, the ``HEAVY`` most frequent of them at most,
    are dealt over ``parts`` places, to which their row of the table is copied; the others meet as in a plain join. Even
    tasks do not depend on a hot key being noticed at run time. ``counts`` (keys, ``_n``) saves counting, where it is known.
    """
    tables = [table] if isinstance(table, DataFrame) else table
    if counts is None:
        rows = stored(rows, "rows")
        counts = frequent(rows, keys, least)
    counts = counts.select(*keys, "_n")
    heavy = first_rows(stored(counts.where(F.col("_n") > least), "heavy"), [-F.col("_n"), *keys], HEAVY).select(*keys, F.lit(True).alias("_heavy"))
    if heavy.isEmpty():
        for one in tables:
            rows = rows.join(one, list(keys), "left")
        return rows
    mine = rows.join(F.broadcast(heavy), list(keys), "left")
    mine = mine.withColumn("_place", F.when(F.col("_heavy"), F.floor(F.rand(0) * parts)).otherwise(F.lit(0)).cast("int")).drop("_heavy")
    last = F.when(F.col("_heavy"), F.lit(parts - 1)).otherwise(F.lit(0))
    for one in tables:
        theirs = one.join(F.broadcast(heavy), list(keys), "left").withColumn("_place", F.explode(F.sequence(F.lit(0), last))).drop("_heavy")
        mine = mine.join(theirs, [*keys, "_place"], "left")
    return mine.drop("_place")


def frequent(rows: DataFrame, keys: Sequence[str], least: int = 10_000) -> DataFrame:
    """The keys of more than ``least`` rows with their number as ``_n``, written. Counts when called; reads only the keys."""
    return stored(_frequent(rows, keys, least).where(F.col("_n") > least), "frequent")


def by_key(
    rows: DataFrame, key: str, run: Callable[[DataFrame], DataFrame], least: int = 10_000, apart: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``run(rows)``, where what it makes of a key depends on the rows of that key alone, with rows exchanged once.

    Rows are dealt by their key, where all steps by this key, or by it and others, find them in place. Keys of more than
    ``least`` rows are counted first, when called; theirs are left to the steps, which reduce them in each task and exchange
    them by all their keys (``apart`` names other steps for them).
    """
    heavy = first_rows(frequent(rows, [key], least), [-F.col("_n"), key], HEAVY).select(key)
    if heavy.isEmpty():
        return run(rows.repartition(key))
    few = F.broadcast(heavy)
    return run(rows.join(few, key, "left_anti").repartition(key)).unionByName((apart or run)(rows.join(few, key, "left_semi")))


def _frequent(rows: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """All keys of more than ``least`` rows, and others, with their number of rows as ``_n``.

    Rows are counted by bucket of a hash, which shrinks in each task; only the keys of full buckets are counted themselves.
    """
    bucket, n = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)), F.count(F.lit(1))
    full = rows.groupBy(bucket.alias("_bucket")).agg(n.alias("_n")).where(F.col("_n") > least).select("_bucket")
    return rows.withColumn("_bucket", bucket).join(F.broadcast(full), "_bucket", "left_semi").groupBy(*keys).agg(n.alias("_n"))


def with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a global aggregate (one row by construction) to every row."""
    keyed = one_row.withColumn("_all", F.lit(1))
    return df.withColumn("_all", F.lit(1)).join(F.broadcast(keyed), "_all").drop("_all")


def running_total(df: DataFrame, order: str, value: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``order`` (a unique, non-negative long).

    Three levels: rows in blocks of ``width`` order values, blocks in groups of ``width``, and the groups, of
    which one task sees one row for each ``width`` squared order values.
    """
    blocked = df.withColumn("_block", F.expr(f"{order} div {width}"))
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_total")).withColumn("_group", F.expr(f"_block div {width}"))
    grouped = _prefix(totals, ["_group"], [F.col("_block")], F.col("_total"), "_start").select("_block", F.col("_start").alias("_ahead"))
    return _within(blocked, ["_block"], [F.col(order)], F.col(value), grouped, name).drop("_block")


def dense_index(df: DataFrame, order: str, name: str, start: int = 0, width: int = 1 << 16) -> DataFrame:
    """Position of each row in ``order`` (a unique, non-negative long), without a global sort."""
    counted = running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name, width)
    return counted.withColumn(name, F.col(name) + start).drop("_one")


def dense_index_by(df: DataFrame, blocks: Sequence[str], order: Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """Position of each row when the blocks are ordered and rows are ordered inside a block."""
    counted = _prefix(df.withColumn("_one", F.lit(1).cast("long")), blocks, order, F.col("_one"), name)
    return counted.withColumn(name, F.col(name) + start).drop("_one")


def _prefix(df: DataFrame, blocks: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    totals = df.groupBy(*blocks).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*blocks, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    return _within(df, blocks, order, value, offsets, name)


def _within(
    df: DataFrame, blocks: Sequence[str], order: Sequence[Column], value: Column, offsets: DataFrame, name: str
) -> DataFrame:
    inside = Window.partitionBy(*blocks).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets, list(blocks))
    out = joined.withColumn(name, (F.col("_ahead") + F.col("_inside")).cast("long"))
    return out.drop("_ahead", "_inside")


def hash_order(seed: int | str, *keys: Column) -> Column:
    """Deterministic shuffle key; replaces a seeded random generator."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)


def unit_hash(seed: int | str, *keys: Column) -> Column:
    """Deterministic number in [0, 1) per key: the first 32 bits of its sha256."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def evenly_spaced(length: Column, limit: Column | int) -> Column:
    """Sorted distinct positions spread over 0..length-1 (half-even rounding)."""
    n = length.cast("int")
    k = (limit if isinstance(limit, Column) else F.lit(limit)).cast("int")
    last = F.greatest(n - 1, F.lit(0))
    spread = F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))),
            lambda i: F.bround(i * last / F.greatest(k - 1, F.lit(1)), 0).cast("int"),
        )
    )
    return (
        F.when((n <= 0) | (k <= 0), F.expr("CAST(array() AS ARRAY<INT>)"))
        .when(k >= n, F.sequence(F.lit(0), last))
        .when(k == 1, F.array(F.floor(n / F.lit(2)).cast("int")))
        .otherwise(spread)
    )


def counters(df: DataFrame, dimensions: dict[str, Column], lists: dict[str, Column] | None = None) -> DataFrame:
    """Long counts (metric, key, n) of several dimensions in one pass, and of ``lists`` of keys; NULL keys are left out."""
    pair = lambda metric: lambda key: F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"))
    pairs = [F.array(*[pair(m)(k) for m, k in dimensions.items()])]
    pairs += [F.transform(F.coalesce(keys, F.array().cast("array<string>")), pair(m)) for m, keys in (lists or {}).items()]
    exploded = df.select(F.inline(F.concat(*pairs) if lists else pairs[0])).where(F.col("key").isNotNull())
    return exploded.groupBy("metric", "key").agg(F.count(F.lit(1)).alias("n"))
