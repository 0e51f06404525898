"""Sharding by histogram sort, with DataFrame functions only.

Documents are ordered by key: the hash of the text, then a hash of the row, so that equal texts stand together. Between
one shard and the next there is a splitter. For all splitters at once the exact bytes below evenly spaced candidate
boundaries are counted (partial sums in every task, one sum per candidate); the boundary nearest to a splitter's share is
taken if it is within the tolerance, and else the cell that holds the share is probed more finely, ``DIGIT`` bits a
round. A splitter thus falls between texts where it can, and only a group of equal texts too large for the tolerance is
cut, inside, by the second hash. When all splitters stand, the rows are exchanged once, by range of shard and key; places
within the shards follow from the row counts of the sorted partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise.llm import common
from plywise.llm.common import partitions, stored

SHARDS = 16
#: Most bytes between a splitter and its share, as a part of a shard's share.
TOLERANCE = 0.001
DIGIT = 12
_TOP = -(1 << 63)


def _digits() -> list[tuple[str, int, int]]:
    """The digits of a key, from the highest: hash, shift, bits."""
    found = []
    for name in ("h1", "h2"):
        at = 64
        while at > 0:
            bits = min(DIGIT, at)
            at -= bits
            found.append((name, at, bits))
    return found


def splitters(rows: DataFrame, n_shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The least keys (h1, h2; unsigned) of the shards 1 and up, from rows with h1, h2 (long) and size.

    The driver sees the counts of at most (n_shards - 1) * 2^DIGIT candidates a round; there are twelve rounds at most.
    """
    digits = _digits()
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / n_shards
    found: dict[int, tuple[int, int]] = {}
    active: dict[tuple[int, int], list[tuple[int, int]]] = {(0, 0): [(s, 0) for s in range(1, n_shards)]}  # prefix -> (splitter, bytes below)
    for name, shift, bits in digits:
        if not active:
            break
        digit = F.shiftrightunsigned(name, shift).bitwiseAND((1 << bits) - 1).alias("digit")
        if name == "h1":
            prefix = F.shiftrightunsigned("h1", shift + bits) if shift + bits < 64 else F.lit(0).cast("long")
            wanted = prefix.isin([_signed(p[0]) for p in active])
            columns = [prefix.alias("p1"), F.lit(0).cast("long").alias("p2")]
        else:
            prefix = F.shiftrightunsigned("h2", shift + bits) if shift + bits < 64 else F.lit(0).cast("long")
            wanted = F.lit(False)
            for p1, p2 in active:
                wanted = wanted | ((F.col("h1") == _signed(p1)) & (prefix == _signed(p2)))
            columns = [F.col("h1").alias("p1"), prefix.alias("p2")]
        counted = rows.where(wanted).groupBy(*columns, digit).agg(F.sum("size").alias("bytes"))
        cells: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in counted.collect():
            cells.setdefault((r["p1"] % (1 << 64), r["p2"] % (1 << 64)), []).append((r["digit"], r["bytes"]))
        last = (name, shift, bits) == digits[-1]
        finer: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (p1, p2), waiting in active.items():
            own = sorted(cells.get((p1, p2), []))
            for splitter, below in waiting:
                want, at = splitter * share, below
                for d, size in own:
                    if at + size >= want:
                        break
                    at += size
                else:
                    d, size = (own[-1][0] + 1, 0) if own else (0, 0)
                lower, upper = want - at, at + size - want
                if min(lower, upper) <= tolerance * share or last or not size:
                    step = int(upper < lower)
                    found[splitter] = _key(name, shift, bits, p1, p2, d + step)
                else:
                    key = (p1 << bits | d, 0) if name == "h1" else (p1, p2 << bits | d)
                    finer.setdefault(key, []).append((splitter, at))
        active = finer
    keys = [found.get(s, ((1 << 64) - 1, (1 << 64) - 1)) for s in range(1, n_shards)]
    for i in range(1, len(keys)):
        keys[i] = max(keys[i], keys[i - 1])
    return keys


def _key(name: str, shift: int, bits: int, p1: int, p2: int, digit: int) -> tuple[int, int]:
    """The least key whose digits are the given ones; a digit beyond its range carries over."""
    if name == "h1":
        h1, h2 = (p1 << bits) + digit << shift, 0
    else:
        h1, h2 = p1, (p2 << bits) + digit << shift
    h1, h2 = h1 + (h2 >> 64), h2 % (1 << 64)
    return (h1, h2) if h1 < 1 << 64 else ((1 << 64) - 1, (1 << 64) - 1)


def _signed(x: int) -> int:
    x %= 1 << 64
    return x - (1 << 64) if x >= 1 << 63 else x


def _rank(column: str) -> Column:
    """A hash, so that the order of longs is that of unsigned numbers."""
    return F.col(column).bitwiseXOR(F.lit(_TOP))


def shard_of(keys: list[tuple[int, int]]) -> Column:
    """The shard of a key: the number of splitters at or below it."""
    total = F.lit(0)
    for h1, h2 in keys:
        a, b = _signed(h1 ^ 1 << 63), _signed(h2 ^ 1 << 63)
        total = total + ((_rank("h1") > a) | (_rank("h1") == a) & (_rank("h2") >= b)).cast("int")
    return total


def sharded(docs: DataFrame, n_shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes plus one), ``text_crc32``, ``shard`` and ``slot`` of every row.

    A null text has no bytes, and the crc32 of the empty text. Rows alike in doc_id and text take neighbouring places.
    An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    text = common.text_or_empty().cast("binary")
    rows = stored(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
                              F.xxhash64(common.text_or_empty()).alias("h1"), F.xxhash64("doc_id", common.text_or_empty()).alias("h2")))
    keys = splitters(rows, n_shards, tolerance)
    n = partitions(spark, rows.count() * 48)
    order = ["shard", _rank("h1"), _rank("h2"), "doc_id"]
    dealt = rows.withColumn("shard", shard_of(keys)).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("id", F.monotonically_increasing_id()))
    part, index = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    # One row for each partition and shard that meet: n + n_shards - 1 at most.
    counts = placed.groupBy(part.alias("part"), "shard").agg(F.count("*").alias("n"), F.min(index).alias("first")).collect()
    starts, at = [], 0
    last = None
    for r in sorted(counts, key=lambda r: (r["shard"], r["part"])):
        at = 0 if r["shard"] != last else at
        last = r["shard"]
        starts.append((r["part"], r["shard"], at - r["first"]))
        at += r["n"]
    moved = spark.createDataFrame(starts, "part long, shard int, move long")
    return (placed.withColumn("part", part).join(F.broadcast(moved), ["part", "shard"])
            .select("doc_id", "size", "text_crc32", "shard", (index + F.col("move")).alias("slot")))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = sharded(common.table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
