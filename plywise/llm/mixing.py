"""Mixing sources to target weights, with DataFrame functions only.

The documents of a source, in an order of their own (a hash), form one stream of words, which is cut into blocks of
``BLOCK`` words; what is left at its end is a shorter block, the last one. The mix is a sequence of slots, each for one
block, dealt into output shards of ``SHARD`` slots. Every shard draws how many of its slots each source fills from a
multinomial distribution over the targets: every slot takes one of ``GRID`` cells by its hash, and the cells are shared
out to the sources by target. A source's slots are numbered through the shards, and number k of a source stands for
block pi(k) of its stream, where pi is a pseudorandom permutation of the source's block numbers, another one for each
time that the stream is gone through (an epoch). Slots are then joined to the documents' pieces by block number.

The draws decide in which shard a block lands, not how often a source is taken: numbers beyond a source's quota (its
target in blocks) are dropped from their shard, and those that the draws left out are dealt to shards by hash, so that a
source gives exactly its quota, and the last slot only as many words as are left of the target.

The permutation is a swap-or-not shuffle: in each round a number and its mirror image about a secret number swap, or
not, by the hash of the larger one. That permutes any range exactly, forwards, with nothing stored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plywise.llm import common
from plywise.llm.common import partitions, stored

#: Words in a block, slots in an output shard, cells of the draw, rounds of the permutation.
BLOCK = 512
SHARD = 16_384
GRID = 65_536
ROUNDS = 24
WEIGHTS = (1, 2, 3)
MOST = 3


def words_of(text: str | Column = "text") -> Column:
    """Number of words of a text: runs of characters other than space and 0x09-0x0D; zero for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def permuted(k: Column, n: Column, *seed: Column) -> Column:
    """Number ``k`` (0 to n - 1) under the pseudorandom permutation of the range that ``seed`` names."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(F.lit("mirror"), r, *seed) - x, n)
        return F.when(F.xxhash64(F.lit("swap"), r, F.greatest(x, other), *seed).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k.cast("long"), swap)


def targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``rank`` and ``target`` from one row per source (source, source_size).

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ...; targets share the sum of all sizes by weight, and
    stop at three times a source's size, where the excess is shared again by weight until none is above. That is the
    level at which ``least(3 size, level * weight)`` sums to the total, found from sums over the sources by ratio of
    size to weight. There is a row for each source here, and none for each document.
    """
    every = W.partitionBy()
    by_ratio = W.orderBy("ratio", "rank")
    ranked = (sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
              .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.col("rank") % len(WEIGHTS) + 1))
              .withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
              .withColumn("ratio", F.col("cap") / F.col("weight"))
              .withColumn("total", F.sum("source_size").over(every))
              .withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
              .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
              .withColumn("level", (F.col("total") - F.col("full")) / F.col("open")))
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)
    return (ranked.withColumn("level", F.coalesce(fits["level"], F.lit(0.0)))
            .select("source", "source_size", "rank", F.least("cap", F.col("level") * F.col("weight")).alias("target")))


def streams(docs: DataFrame, n_docs: int) -> DataFrame:
    """Adds ``at``, where a document's words begin in the stream of its source (columns key, source, size).

    Running sums in two steps: within chunks of a source, and over the sums of its chunks. Chunks are about as many as
    the rows in each, so neither step sees more than the root of the number of rows at once, whatever a source's share.
    """
    n_chunks = math.isqrt(n_docs) + 1
    order = F.xxhash64("key", F.lit("order"))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit("chunk")), F.lit(n_chunks)).cast("int"))
    before = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = docs.groupBy("source", "chunk").agg(F.sum("size").alias("size")).select(
        "source", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("chunk_at"))
    within = W.partitionBy("source", "chunk").orderBy(order, "key").rowsBetween(W.unboundedPreceding, -1)
    placed = docs.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    own, other = placed.alias("p"), chunks.alias("c")
    same = F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.chunk") == F.col("c.chunk"))
    return own.join(other, same).select("p.key", "p.source", "p.size", (F.col("p.at") + F.col("c.chunk_at")).alias("at"))


def slots(sources: DataFrame) -> DataFrame:
    """The mix: ``shard``, ``source``, ``number``, ``epoch``, ``block`` and ``words`` (how many of the block's are taken).

    ``sources`` has source, source_size, rank and target.
    """
    size = F.col("source_size")
    own = (sources.where("source_size > 0")
           .withColumn("quota", F.least(F.round("target").cast("long"), MOST * size))
           .withColumn("full_blocks", F.expr(f"source_size div {BLOCK}"))
           .withColumn("blocks", F.expr(f"source_size div {BLOCK}") + (size % BLOCK > 0).cast("long"))
           .withColumn("epochs", F.expr("quota div source_size"))
           .withColumn("rest", F.col("quota") % size)
           .withColumn("n_slots", F.col("epochs") * F.col("blocks") + F.expr(f"(rest + {BLOCK} - 1) div {BLOCK}"))
           .withColumn("high", F.sum("n_slots").over(W.orderBy("rank")))
           .withColumn("all_slots", F.sum("n_slots").over(W.partitionBy())))
    own = stored(own)  # a row for each source
    totals = own.agg(F.max("all_slots")).first()[0] or 0
    n_shards = max(1, -(-int(totals) // SHARD))
    cells = own.where("n_slots > 0").select("rank", F.explode(F.expr(
        f"sequence(((high - n_slots) * {GRID}) div all_slots, (high * {GRID}) div all_slots)")).alias("cell"))
    cells = cells.groupBy("cell").agg(F.max("rank").alias("rank"))  # GRID + 1 at most
    draws = own.sparkSession.range(int(totals)).select(
        (F.expr(f"id div {SHARD}")).alias("shard"), F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(GRID)).alias("cell"))
    counts = draws.join(F.broadcast(cells), "cell").groupBy("rank", "shard").agg(F.count("*").alias("n"))
    upto = W.partitionBy("rank").orderBy("shard")
    runs = counts.withColumn("stop", F.sum("n").over(upto)).withColumn("start", F.col("stop") - F.col("n"))
    drawn = runs.groupBy("rank").agg(F.max("stop").alias("drawn"))
    info = own.select("rank", "source", "source_size", "quota", "full_blocks", "blocks", "epochs", "rest", "n_slots")
    # A row for each source and shard grows to all its slots, so these few rows are spread first.
    n = partitions(own.sparkSession, int(totals) * 64)
    kept = (runs.join(info, "rank").where("start < n_slots").repartition(n, "rank", "shard")
            .select(*info.columns, F.col("shard"), F.explode(F.sequence("start", F.least("stop", "n_slots") - 1)).alias("number")))
    missed = (info.join(drawn, "rank", "left").where("coalesce(drawn, 0) < n_slots")
              .select(*info.columns, F.explode(F.sequence(F.coalesce("drawn", F.lit(0).cast("long")), F.col("n_slots") - 1)).alias("number"))
              .withColumn("shard", F.pmod(F.xxhash64("rank", "number", F.lit("missed")), F.lit(n_shards))))
    every = kept.unionByName(missed)
    epoch = F.expr("number div blocks")
    k = F.col("number") % F.col("blocks")
    block = F.when(k < F.col("full_blocks"), permuted(k, F.col("full_blocks"), F.col("rank"), epoch)).otherwise(k)
    length = F.least(F.lit(BLOCK).cast("long"), size - block * BLOCK)
    last = (epoch == F.col("epochs")) & (F.col("number") == F.col("n_slots") - 1)
    words = F.when(last, F.least(length, F.col("rest") - k * BLOCK)).otherwise(length)
    return every.select("shard", "rank", "source", "number", epoch.alias("epoch"), block.alias("block"), words.alias("words"))


def mixed(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of ``docs`` (``keys`` and columns text, source) with size, source_size, target and taken.

    A null text has size zero and is never taken; null is a source of its own, after all others. ``keys`` only carry
    over; rows alike in all of them and in text get equal places next to each other, each counted. An empty table gives
    an empty result.
    """
    rows = docs.select(F.struct(*keys).alias("key0"), "source", words_of().alias("size"), F.xxhash64("text").alias("h"))
    rows = stored(rows.select(F.struct("key0", "h").alias("key"), "source", "size"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = stored(targets(sizes.select("source", "source_size")))
    n_docs = rows.count()
    placed = stored(streams(rows.where("size > 0"), n_docs))
    known = sources.select("rank", "source", "source_size", "target")
    own, other = placed.alias("p"), known.alias("s")
    pieces = (own.join(other, F.col("p.source").eqNullSafe(F.col("s.source")))
              .select("p.key", "p.size", "p.at", "s.rank", "s.source_size", "s.target")
              .withColumn("block", F.explode(F.expr(f"sequence(at div {BLOCK}, (at + size - 1) div {BLOCK})"))))
    takes = slots(sources).groupBy("rank", "block").agg(F.collect_list("words").alias("words"))  # as many as epochs: 4 at most
    low = F.greatest(F.col("at") - F.col("block") * BLOCK, F.lit(0).cast("long"))
    high = F.least(F.col("at") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK).cast("long"))
    part = F.aggregate("words", F.lit(0).cast("long"), lambda total, w: total + F.greatest(F.least(high, w) - low, F.lit(0).cast("long")))
    counted = (pieces.join(takes, ["rank", "block"], "left").withColumn("part", F.coalesce(part, F.lit(0)))
               .groupBy("rank", "at", "size", "key").agg(F.sum("part").alias("taken"), F.first("source_size").alias("source_size"),
                                                         F.first("target").alias("target")))
    own = rows.where("size = 0").alias("p")
    empty = (own.join(other, F.col("p.source").eqNullSafe(F.col("s.source")))
             .select("p.key", "p.size", F.lit(0).cast("long").alias("taken"), "s.source_size", "s.target"))
    both = counted.select("key", "size", "taken", "source_size", "target").unionByName(empty)
    return both.select("key.key0.*", "size", "source_size", "target", "taken")


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents", "doc_id", "text", "source")
    return mixed(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
