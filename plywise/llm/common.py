"""What the operators share: reading tables, tables that cut lineage, pieces of Arrow batches, components of a graph."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise import session

#: Bytes of text that a task looks at in one go; a longer text is a piece of its own.
PIECE_BYTES = 1_000_000


def shipped(*modules: str) -> None:
    """Sends these modules along with the functions that tasks run, so that executors need no copy of the package."""
    for name in (__name__, *modules):
        cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    return session.stored(df, "plywise")


def partitions(spark: SparkSession, total_bytes: int, each: int = 16_000_000) -> int:
    """So many partitions that each holds about ``each`` bytes, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // each))


def spread_join(big: DataFrame, small: DataFrame, key: str, rows: str = "rows") -> DataFrame:
    """``big`` with the columns of ``small``, whose keys are unique and say in ``rows`` how many rows of ``big`` have them.

    Keys of over a thousandth of all rows, so at most a thousand keys, go to the rows where these are; only the others
    meet by an exchange, in which no key is hot. ``rows`` is left out of the result.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    hot = small.where(F.col(rows) > max(1000, total // 1000)).drop(rows)
    small = small.drop(rows)
    if hot.isEmpty():
        return big.join(small, key)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.join(F.broadcast(hot.select(key)), key, "left_anti"), key)
    return big.join(F.broadcast(hot), key).unionByName(rest)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows so that a piece holds about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column)
        offsets, _ = raw(sizes)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings (null as empty), without a copy where there is no null."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    first = first.astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return first - first[0], whole[first[0] : first[-1]]


def strings(column: pa.Array) -> list[bytes]:
    offsets, data = raw(column)
    whole, ends = data.tobytes(), offsets.tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def blobs(buckets: np.ndarray, n: int, /, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket that occurs: its number and, packed as bytes, its part of every column."""
    order = np.argsort(buckets, kind="stable")
    counts = np.bincount(buckets, minlength=n)
    ends = np.cumsum(counts)
    used = np.flatnonzero(counts)
    packed = {k: v[order] for k, v in columns.items()}
    arrays = [pa.array(used.astype(np.int32))]
    for v in packed.values():
        arrays.append(pa.array([v[ends[i] - counts[i] : ends[i]].tobytes() for i in used], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *packed])


def unpacked(batches: Iterator[pa.RecordBatch], **types: type | str) -> dict[str, np.ndarray]:
    """All rows of a task's partition of ``blobs``, one array for each column."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in types}
    for batch in batches:
        for k, kind in types.items():
            parts[k].append(raw(batch.column(k))[1].view(kind).copy())
    return {k: np.concatenate(v) if v else np.zeros(0, types[k]) for k, v in parts.items()}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def small_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges that one task holds, and for each the least node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(left):
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        live = low != high
        if not live.any():
            break
        left, right, low, high = left[live], right[live], low[live], high[live]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return nodes, nodes[root]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a partition, in blocks, as stars with the same components."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
        nodes, root = small_components(a, b)
        keep = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components: for each node of the edges (a, b; longs) ``node`` and ``root``, the least node it reaches.

    Alternates large stars and small stars, which keeps the number of rounds near the logarithm of a component's size.
    Every round is a minimum per node (combined before the shuffle) and a join, and is written to the shared folder. A
    node with very many neighbours is a skewed join, which Spark splits. The driver sees one checksum a round.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def distinct(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = stored(distinct(edges.mapInArrow(contracted, "a long, b long")))
    seen = state(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(distinct(large))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stored(distinct(small.select("e.*")))
        was, seen = seen, state(now)
        if was == seen:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


Query = Callable[[SparkSession, str], DataFrame]
