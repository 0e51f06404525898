"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint has 64 bits, in four blocks of 16. Of three differing bits one block holds at least one, so without that
block at most two are left, and the balls of radius one (half of two) around both rests share a variant. Every distinct
fingerprint therefore emits, for each block left out, the 49 variants of the rest within radius one; variants are
shuffled, and those that collide are linked inside their group in time linear in the group's size:

* same block values, or block values one bit apart: the fingerprints are within 2 + 1 bits, so each is linked to the
  first with its value, and these to each other;
* equal rests: block values within three bits meet on a variant within one bit of one and two of the other.

Every pair within three bits falls under one of the two rules: leave out the block with the fewest differing bits, but
at least one; if it has one, the first rule holds, and if not, all three bits (or both) lie in it and the second holds.
Each link is verified by counting bits. Copies share a fingerprint and are one node, so no group of copies is expanded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise.llm import common, jaccard
from plywise.llm.common import blobs, components, mixed, partitions, pieces, spread_join, stored, strings, unpacked

RADIUS = 3
SEED = 42
_BLOCKS, _BLOCK_BITS, _REST = 4, 16, 48
_MIN_BUCKETS = 1024


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles of a text (UTF-8), repeats included.

    A-Z are lower-cased, words are cut at space and 0x09-0x0D. A text with fewer words than a shingle is one shingle; a
    text without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    stops = (ends[k - 1 :] - 1).tolist()
    starts = [0, *ends[: len(stops) - 1].tolist()]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; none for no hash."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the word shingles of a text: a bit is set if it is set in over half the shingles' hashes."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (long) of every row; a null text counts as empty. Rows never leave their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in strings(piece.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _rest(fps: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The 48 bits besides a block, and the block's 16 bits."""
    low = np.uint64((1 << (_BLOCK_BITS * block)) - 1)
    at = np.uint64(_BLOCK_BITS * block)
    return (fps & low) | ((fps >> at) >> np.uint64(_BLOCK_BITS)) << at, (fps >> at) & np.uint64(0xFFFF)


def _variants(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(_REST, dtype=np.uint64)]).astype(np.uint64)
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for block in range(_BLOCKS):
                rest, _ = _rest(fps, block)
                keys = rest[:, None] ^ flips[None, :] | np.uint64(block << _REST)
                buckets = (mixed(keys.ravel()) % np.uint64(n_buckets)).astype(np.int64)
                codes = np.tile(np.arange(block * 49, block * 49 + 49, dtype=np.uint8), len(fps))
                yield blobs(buckets, n_buckets, codes=codes, fps=np.repeat(fps, 49))

    return run


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def collisions(codes: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of the variants in one task; see the module's text for the two rules."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(_REST, dtype=np.uint64)]).astype(np.uint64)
    keys, values = np.empty(len(fps), np.uint64), np.empty(len(fps), np.uint64)
    for block in range(_BLOCKS):
        own = codes // 49 == block
        rest, values[own] = _rest(fps[own], block)
        keys[own] = (rest ^ flips[codes[own] - block * 49]) | np.uint64(block << _REST)
    order = np.lexsort((values, keys))
    keys, values, fps, centre = keys[order], values[order], fps[order], codes[order] % 49 == 0
    same = keys[1:] == keys[:-1]
    live = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(keys) else np.zeros(0, bool)
    keys, values, fps, centre = keys[live], values[live], fps[live], centre[live]
    if not len(keys):
        return fps, fps
    group = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).astype(np.int64)]))
    place = group << 16 | values.astype(np.int64)
    first, at = np.unique(place, return_index=True)
    found = [(fps[at[np.searchsorted(first, place)]], fps)]
    for bit in range(_BLOCK_BITS):
        other = first ^ (1 << bit)
        k = np.minimum(np.searchsorted(first, other), len(first) - 1)
        hit = (first[k] == other) & (other < first)
        found.append((fps[at[k[hit]]], fps[at[hit]]))
    # Equal rests: the centres of a group.
    place, own = place[centre], fps[centre]
    crowd = np.bincount(group[centre])[group[centre]] > 1
    place, own = place[crowd], own[crowd]
    if len(own):
        one = np.concatenate([[0], 1 << np.arange(_BLOCK_BITS)])
        two = np.array([1 << i | 1 << j for i in range(_BLOCK_BITS) for j in range(i)])
        for part in range(0, len(own), 100_000):  # groups are looked up as a whole, links are made from a part at a time
            near = (place[:, None] ^ one[None, :]).ravel()
            source = np.repeat(own, len(one))
            order = np.argsort(near, kind="stable")
            near, source = near[order], source[order]
            some, far = own[part : part + 100_000], place[part : part + 100_000]
            reach = (far[:, None] ^ np.concatenate([one, two])[None, :]).ravel()
            k = np.minimum(np.searchsorted(near, reach), len(near) - 1)
            hit = near[k] == reach
            found.append((source[k[hit]], np.repeat(some, len(one) + len(two))[hit]))
    a, b = (np.concatenate(x) for x in zip(*found))
    right = (a != b) & (_apart(a, b) <= RADIUS)
    return a[right], b[right]


def links(fps: DataFrame, n_fps: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``, at most three bits apart, with the components of all such pairs."""
    spark = fps.sparkSession
    n = partitions(spark, n_fps * _BLOCKS * (_REST + 1) * 9)
    n_buckets = max(_MIN_BUCKETS, 4 * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = unpacked(batches, codes=np.uint8, fps=np.uint64)
        a, b = collisions(x["codes"], x["fps"])
        nodes, root = common.small_components(a.view(np.int64), b.view(np.int64))
        keep = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["a", "b"])

    dealt = fps.select("fp").mapInArrow(_variants(n_buckets), "bucket int, codes binary, fps binary")
    return dealt.repartition(n, "bucket").drop("bucket").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (long) and ``component_id``, the least doc_id among all that its links reach.

    Null and empty texts share fingerprint zero and are linked by it like all others; rows with equal doc_id each get a
    row; a null doc_id is kept, and never names a component unless no other member has an id; an empty table gives an
    empty result; further columns are ignored.
    """
    own = stored(fingerprints(docs, shingle))
    fps = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(fps, fps.count()))
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = stored(placed)
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(placed.join(least, "root").select("fp", "component_id"))
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def _node_fingerprints(shingle: int, number: Callable[[bytes], int]):
    """Nodes of ``jaccard.classes`` with the SimHash of their sets; a text without words has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            sets = [x for x in jaccard.shingle_sets(strings(piece.column("text")), shingle) if len(x)]
            nodes = pa.array([number(n) for n in jaccard.names(sets)], pa.int64())
            fps = np.array([majority(x) for x in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([nodes, pa.array(fps.view(np.int64))], names=["node", "fp"])

    return run


def close_pairs(docs: DataFrame, shingle: int, number: Callable[[bytes], int]) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints are equal or linked; each is one comparison a node."""
    own = stored(docs.select("text").mapInArrow(_node_fingerprints(shingle, number), "node long, fp long").distinct())
    reps = stored(own.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("rows")))
    same = spread_join(own, reps, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    far = links(reps, reps.count())
    ends = reps.select("fp", "rep")
    far = far.join(ends.withColumnRenamed("rep", "x"), F.col("a") == F.col("fp")).drop("fp").join(ends, F.col("b") == F.col("fp"))
    return same.union(far.select(F.col("x").alias("a"), F.col("rep").alias("b")))


def similar(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``jaccard.classes`` of ``docs``, with fingerprints first: near copies whose fingerprints are linked are compared
    and become one class, in one comparison each; what is left of a crowd meets by prefixes, so that no link is lost.

    Fingerprints alone can't say which texts have a similarity of four fifths: at that similarity two of 64 bits differ
    in every thirteen, ten in all, and a ball of that radius holds nearly all fingerprints.
    """
    return jaccard.classes(docs, shingle, percent, lambda texts, number: close_pairs(texts, shingle, number))


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(common.table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


common.shipped(__name__)
