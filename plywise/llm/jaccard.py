"""Join of texts whose sets of word shingles are similar, by grouped prefixes.

In any order of all shingles, two sets with a Jaccard similarity of at least t have a shingle in common among the first
n - ceil(t n) + 1 of each, and where it is the first in common its places bound what follows. The order is from rare to
common: shingles are counted in the place of their hash, and every piece of texts gets the counts of its own shingles back.
Shingles of one text come first and need no list, so texts that share only common words and passages make no candidates.
Texts with the same set are one node, and nodes with the same prefix and size are one group: lists of a shingle hold
groups, pairs of groups are filtered by sizes and places, and only those left are expanded to members, which are
compared set by set.

Only classes are wanted, so pairs within a class need no comparison. In every round each list chooses hubs, one for each
range of sizes: in turn the group with the fewest shingles before the list's own (the text that the others were made
from, if it is there), and any group. Every group takes one of its lists' hubs, never one twice, and its members are
compared with that one. Links found make classes. After a few rounds, or when a round finds no link, or when what is left
is no more than a few pairs a row, all groups of a list that are still of different classes are compared, in blocks; so a
crowd that a few hubs connect costs a few comparisons a member, and no pair is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise.llm import common
from plywise.llm.common import blobs, components, mixed, partitions, pieces, raw, spread_join, stored, strings, unpacked
from plywise.session import released

SHINGLE, PERCENT = 5, 80
#: Shingles, copies included, that ask for their counts at a time, about.
HEAVY = 1 << 20
#: Counts up to this one are told apart in the order, higher ones by the fourth of a power of two.
_COMMON = 16
#: Rounds with hubs, pairs a row from which on no further round is made, and groups of a block.
_ROUNDS, _FEW, _BLOCK = 5, 2, 512
_MIN_BUCKETS = 1024
#: Nodes that are sent to all tasks, at most.
_SENT = 1_000_000
#: Bytes of a text whose words are held as objects at a time, and bytes of the texts that get their counts together, about.
_CUT, _PIECE = 2_000_000, 4_000_000
_SPACE = b" \t\n\x0b\x0c\r"


def word_hashes(text: bytes) -> np.ndarray:
    """XXH64 of the words of a text in order; A-Z are lower-cased, words are cut at space and 0x09-0x0D."""
    parts, at = [], 0
    while at < len(text):
        to = at + _CUT
        while to < len(text) and text[to] not in _SPACE:
            to += 1
        parts.append(np.array(list(map(xxhash.xxh64_intdigest, text[at:to].lower().split())), np.uint64))
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _chained(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k words in a row."""
    n = len(words) - k + 1
    found = np.full(n, k, np.uint64)
    for i in range(k):
        found = mixed(found + words[i : i + n])
    return found


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes.

    A text with fewer words than a shingle is one shingle; a text without words has none.
    """
    words = [word_hashes(t) for t in texts]
    ends = np.cumsum([len(w) for w in words]).tolist()
    whole = np.concatenate(words) if words else np.zeros(0, np.uint64)
    found = _chained(whole, shingle) if len(whole) >= shingle else np.zeros(0, np.uint64)
    sets = []
    for w, end in zip(words, ends):
        if len(w) >= shingle:
            sets.append(np.unique(found[end - len(w) : end - shingle + 1]))
        else:
            sets.append(_chained(w, len(w)) if len(w) else w)
    return sets


def similar_sets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def prefix_length(size: int, percent: int) -> int:
    """So many first shingles of a set that any similar set has one of them among its own first ones."""
    return size - -(-percent * size // 100) + 1


def names(sets: list[np.ndarray]) -> list[bytes]:
    return [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]


def _node(name: bytes, clashes: dict[bytes, int]) -> int:
    """The number of a set: half of its 128-bit name, or the other half where two names agree in the first."""
    return clashes.get(name, int.from_bytes(name[:8], "little", signed=True))


def _owned(shingle: int):
    """Rows with the name and size of their sets, and the text where its set is new to the task, numbered by pieces and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        part = held = place = 0
        for piece in pieces(batches, "text"):
            column = piece.column("text")
            texts = strings(column)
            sets = shingle_sets(texts, shingle)
            found, new, parts = names(sets), [], []
            for text, x, name in zip(texts, sets, found):
                new.append(len(x) > 0 and name not in seen)
                parts.append(part)
                if new[-1]:
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(name)
                    held += len(text)
                    if held >= _PIECE:
                        part, held = part + 1, 0
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(found, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(parts, pa.int32()),
                 pa.array(np.arange(place, place + n)), column.take(pa.array(np.arange(n), mask=~np.array(new, bool)))],
                names=["doc_id", "name", "size", "part", "place", "text"])
            place += n

    return run


def _asked(shingle: int, n_buckets: int):
    """The shingles of consecutive texts of a piece by bucket, packed: half of each hash, and the number of texts.

    ``place`` is that of the first of these texts; the next request of the piece begins where this one ends.
    """

    def packed(piece: int, place: int, sets: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(sets), return_counts=True)
        found = blobs(_buckets(token, n_buckets), n_buckets, token=_half(token), n=_level(n))
        rows = found.num_rows
        return pa.RecordBatch.from_arrays([*found.columns, pa.array(np.full(rows, piece)), pa.array(np.full(rows, place))], names=[*found.schema.names, "piece", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = first = last = many = 0
        for batch in pieces(batches, "text"):
            of, places = (batch.column(k).to_pylist() for k in ("piece", "place"))
            for piece, place, x in zip(of, places, shingle_sets(strings(batch.column("text")), shingle)):
                if held and (piece != now or place <= last or many >= HEAVY):
                    yield packed(now, first, held)
                    held, many = [], 0
                if not held:
                    now, first = piece, place
                held.append(x)
                last, many = place, many + len(x)
        if held:
            yield packed(now, first, held)

    return run


def _buckets(token: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mixed(token) % np.uint64(n_buckets)).astype(np.int64)


def _half(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(32)).astype(np.uint32)


def _level(n: np.ndarray) -> np.ndarray:
    """Counts as bytes that grow with them: exact up to ``_COMMON``, then by the fourth of a power of two."""
    above = np.floor(4 * np.log2(np.maximum(n, _COMMON) / _COMMON))
    return np.where(n <= _COMMON, n, _COMMON + above).clip(0, 255).astype(np.uint8)


def _count(level: np.ndarray) -> np.ndarray:
    return np.where(level <= _COMMON, level, np.ceil(_COMMON * 2.0 ** ((level.astype(np.float64) - _COMMON) / 4)))


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To every request the levels of its shingles' counts in all texts, in its order. Halves that agree count together."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    sizes = np.concatenate([np.diff(raw(b.column("n"))[0]) for b in held])
    x = unpacked(iter(held), token=np.uint32, n=np.uint8)
    bucket = np.concatenate([b.column("bucket").to_numpy() for b in held]).astype(np.uint64)
    token, at = np.unique(np.repeat(bucket, sizes) << np.uint64(32) | x["token"], return_inverse=True)
    level = _level(np.bincount(at, _count(x["n"]), minlength=len(token)))[at]
    ends = np.cumsum(sizes)
    done = 0
    for b in held:
        stops = ends[done : done + b.num_rows]
        begin = int(stops[0] - sizes[done])
        offsets = np.concatenate([[0], stops - begin]).astype(np.int32)
        levels = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(level[begin : stops[-1]].tobytes())])
        yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("place"), b.column("bucket"), levels], names=["piece", "place", "bucket", "levels"])
        done += b.num_rows


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows that follow each other with one key."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, stop in zip(cuts, cuts[1:]):
            if held and keys[start] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = keys[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _levels(sets: list[np.ndarray], answers: list[tuple[int, bytes]], n_buckets: int) -> np.ndarray:
    """The levels of the sets' shingles, one set after the other, from the answers to their request, by bucket."""
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    got = np.frombuffer(b"".join(levels for _, levels in sorted(answers)), np.uint8)
    if len(got) != len(token):
        raise RuntimeError(f"{len(got)} counts for {len(token)} shingles")
    level = np.empty(len(token), np.uint8)
    level[np.argsort(_buckets(token, n_buckets), kind="stable")] = got
    return level[at]


def _postings(shingle: int, percent: int, clashes: dict[bytes, int], n_buckets: int):
    """What others may share of the sets' prefixes, by bucket of the shingle, packed: shingle, node, group, size and place
    in the order. The rows are pieces of texts (bucket -1), each followed by the counts that it asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "piece"):
            table = table.combine_chunks()
            bucket = table.column("bucket").to_numpy()
            n = int((bucket < 0).sum())
            place = table.column("place").to_numpy()
            sets = shingle_sets([t.encode() for t in table.column("text")[:n].to_pylist()], shingle)
            name = table.column("name")[:n].to_pylist()
            answers: dict[int, list[tuple[int, bytes]]] = {}
            for p, b, levels in zip(place[n:].tolist(), bucket[n:].tolist(), table.column("levels")[n:].to_pylist()):
                answers.setdefault(p, []).append((b, levels))
            starts = np.searchsorted(place[:n], sorted(answers)).tolist()
            rows: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
            for p, start, stop in zip(sorted(answers), starts, [*starts[1:], n]):
                level = _levels(sets[start:stop], answers[p], n_buckets)
                end = 0
                for x, own in zip(sets[start:stop], name[start:stop]):
                    ranks = level[end : end + len(x)]
                    end += len(x)
                    order = np.argsort(ranks, kind="stable")[: prefix_length(len(x), percent)]
                    places = np.flatnonzero(ranks[order] > 1)
                    if len(places):
                        first = x[order]
                        group = hashlib.blake2b(first.tobytes() + len(x).to_bytes(8, "little"), digest_size=8).digest()
                        rows.append((_node(own, clashes), int.from_bytes(group, "little", signed=True), len(x), first[places], places))
            if not rows:
                continue
            node, group, size, first, places = zip(*rows)
            many = np.array([len(x) for x in first])
            token = np.concatenate(first)
            yield blobs(_buckets(token, n_buckets), n_buckets, token=token,
                        node=np.repeat(np.array(node, np.int64), many), group=np.repeat(np.array(group, np.int64), many),
                        size=np.repeat(np.array(size, np.int32), many), place=np.concatenate(places).astype(np.int32))

    return run


def _prefixes(texts: DataFrame, shingle: int, percent: int, clashes: dict[bytes, int], text_bytes: int) -> DataFrame:
    """The prefixes of the sets of ``texts`` (piece, place, name, text), as ``_postings`` has them.

    A text is exchanged once, by its piece; the counts cost five bytes a shingle of a piece and one for the answer.
    """
    n = partitions(texts.sparkSession, text_bytes)
    n_pieces = partitions(texts.sparkSession, text_bytes, 2 * _PIECE)  # a few pieces a task, as chance deals them
    n_buckets = max(_MIN_BUCKETS, 2 * n)
    asked = texts.select("piece", "place", "text").mapInArrow(_asked(shingle, n_buckets), "bucket int, token binary, n binary, piece long, place long")
    answered = asked.repartition(n, "bucket").mapInArrow(_answered, "piece long, place long, bucket int, levels binary")
    both = texts.withColumns({"bucket": F.lit(-1), "levels": F.lit(None).cast("binary")}).unionByName(answered, allowMissingColumns=True)
    dealt = both.repartition(n_pieces, "piece").sortWithinPartitions("piece", "bucket", "place").mapInArrow(
        _postings(shingle, percent, clashes, n_buckets), "bucket int, token binary, node binary, group binary, size binary, place binary")
    return dealt.repartition(n, "bucket").drop("bucket")


def _shared(percent: int):
    """Rows of shingles that stand in the prefixes of several nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"token": np.uint64, "node": np.int64, "group": np.int64, "size": np.int32, "place": np.int32}
        x = unpacked(batches, **kinds)
        order = np.lexsort((x["node"], x["token"]))
        token, node = x["token"][order], x["node"][order]
        new = np.ones(len(order), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        order, token = order[new], token[new]
        _, at, n = np.unique(token, return_inverse=True, return_counts=True)
        keep = order[n[at] > 1] if len(order) else order
        for i in range(0, len(keep), 100_000):
            columns = [x[k][keep[i : i + 100_000]] for k in kinds]
            columns[0] = columns[0].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(kinds))

    return run


def _may(size: Column, place: Column, other_size: Column, other_place: Column, percent: int) -> Column:
    """Whether sets may be similar whose first common shingle stands at these places."""
    most = F.least(size - place, other_size - other_place)
    return (100 + percent) * most >= percent * (size + other_size)


def _compared(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text of each of ``nodes``. Up to ``_SENT`` nodes are sent to the texts, so that the others are not exchanged."""
    few = nodes.count() <= _SENT
    found = texts.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")
    return found.groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles are similar.

    A text goes once to each hub b that it is compared with. Hubs of many texts stand in several places.
    """
    spark = texts.sparkSession
    hubs = pairs.groupBy("b").agg(F.count("*").alias("rows")).withColumn("places", F.ceil(F.col("rows") / 200))
    dealt = spread_join(pairs, hubs, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("places")).alias("salt"))
    dealt = stored(dealt)
    asked = dealt.select("a", "b", "salt", F.lit(True).alias("later")).union(
        dealt.select(F.col("b").alias("a"), "b", "salt", F.lit(False).alias("later")).distinct())
    held = asked.withColumnRenamed("a", "node").hint("merge").join(texts.select("node", "text"), "node")
    held = held.select("b", "salt", F.col("node").alias("a"), "later", "text")
    held = held.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "b", "salt").sortWithinPartitions("b", "salt", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            for piece in pieces(iter([batch]), "text"):
                later = piece.column("later").to_pylist()
                keep = np.zeros(len(later), bool)
                for i, x in enumerate(shingle_sets(strings(piece.column("text")), shingle)):
                    if later[i]:
                        keep[i] = similar_sets(x, own, percent)
                    else:
                        own = x
                a, b = (piece.column(k).to_numpy(zero_copy_only=False)[keep] for k in ("a", "b"))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return held.mapInArrow(run, "a long, b long")


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("node"))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _hubs(lists: DataFrame, tried: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """For each group the hub (b, a node) that it is compared with in this turn, where both are not of one class."""
    span = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent)))
    lists = lists.withColumn("span", span)
    by_place = turn % 2 == 0
    order = F.struct(*([F.col("place")] if by_place else []), F.xxhash64("group", F.lit(turn)).alias("h"))
    hub = F.min(F.struct(order.alias("o"), "group", "least", "low", "high", "size", "place")).alias("hub")
    hubs = lists.groupBy("token", "span").agg(hub, F.min("low").alias("lowest"), F.max("high").alias("highest"), F.count("*").alias("rows"))
    hubs = stored(hubs.select("token", "span", "rows", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("group", "least", "low", "high", "size", "place")]))
    sizes = hubs.groupBy("token").agg(F.sum("rows").alias("rows"), F.collect_list(F.struct(*[c for c in hubs.columns if c != "token"])).alias("hubs"))
    named = spread_join(lists, sizes, "token").withColumn("hub", F.explode("hubs")).drop("hubs").select("*", "hub.hub_group", "hub.hub_least", "hub.hub_low", "hub.hub_high",
                                                                                               "hub.hub_size", "hub.hub_place")
    apart = (F.col("low") != F.col("hub_low")) | (F.col("high") != F.col("hub_high")) | (F.col("low") != F.col("high"))
    named = named.where(apart & _may(F.col("size"), F.col("place"), F.col("hub_size"), F.col("hub_place"), percent))
    votes = named.groupBy("group", "hub_least").agg(F.count("*").alias("votes"), F.avg("hub_place").alias("mean"))
    if tried is not None:
        votes = votes.join(tried.withColumnRenamed("b", "hub_least"), ["group", "hub_least"], "left_anti")
    wanted = F.struct((-F.col("mean")).alias("near") if by_place else F.col("votes").alias("near"), "votes", "hub_least")
    return votes.groupBy("group").agg(F.max_by("hub_least", wanted).alias("b"))


def _hub_pairs(hubs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Pairs (a, b) of the groups' members with their hubs, where both are of different classes."""
    root = rooted.select(F.col("node").alias("b"), F.col("root").alias("hub_root"))
    named = hubs.groupBy("b").agg(F.count("*").alias("rows")).join(root, "b")
    pairs = spread_join(rooted.join(hubs, "group"), named, "b").where("root <> hub_root")
    return pairs.select(F.col("node").alias("a"), "b").distinct()


def _block_pairs(percent: int, counted: bool = False):
    """Pairs of groups of a list's blocks that may be similar and are not of one class, (x, y) with x <= y; or their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        names = ("token", "one", "two", "block", "group", "low", "high", "size", "place")
        table = pa.Table.from_batches(held).sort_by([(k, "ascending") for k in names[:4]])
        token, one, two, block, group, low, high, size, place = (table.column(k).to_numpy().astype(np.int64) for k in names)
        first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        ends = np.append(first[1:], len(token))
        sizes = ends - first
        left = np.add.reduceat((block == one).astype(np.int64), first)
        # A row's partners are the later rows of its block, or all rows of the other block.
        start = np.where(one == two, np.arange(len(token)) + 1, np.repeat(first + left, sizes))
        stop = np.where((one == two) | (block == one), np.repeat(ends, sizes), start)
        total = 0
        alone = np.flatnonzero((one == two) & (low != high))
        for i, j in chain([(alone, alone)], ranges(start, stop)):
            apart = (low[i] != low[j]) | (high[i] != high[j]) | (low[i] != high[i])
            i, j = i[apart], j[apart]
            most = np.minimum(size[i] - place[i], size[j] - place[j])
            may = (100 + percent) * most >= percent * (size[i] + size[j])
            i, j = i[may], j[may]
            total += len(i)
            if len(i) and not counted:
                both = np.unique(np.stack([np.minimum(group[i], group[j]), np.maximum(group[i], group[j])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["x", "y"])
        if counted:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    return run


def ranges(start: np.ndarray, stop: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place in ``start``, number from start to stop), in parts of about ``most`` where single ranges are shorter."""
    total = np.concatenate([[0], np.cumsum(stop - start)])
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        n = np.diff(total[at : to + 1])
        of = np.repeat(np.arange(at, to), n)
        yield of, start[of] + np.arange(len(of)) - np.repeat(total[at:to] - total[at], n)
        at = to


def _blocks(lists: DataFrame) -> DataFrame:
    """The groups of lists with several classes, in blocks, for each pair of blocks."""
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = lists.groupBy("token").agg(F.min("low").alias("lowest"), F.max("high").alias("highest"), F.count("*").alias("rows"))
    blocks = F.ceil(F.col("rows") / _BLOCK).cast("int").alias("blocks")
    whole = stored(whole.where("lowest < highest").select("token", "rows", blocks))
    own = spread_join(lists, whole, "token").withColumn("block", F.pmod(F.xxhash64("group"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("token", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "group", "low", "high", "size", "place")
    return own.repartition(n, "token", "one", "two")


def _left_pairs(blocks: DataFrame, rooted: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of nodes of different classes whose groups meet in a list and may be similar."""
    found = blocks.mapInArrow(_block_pairs(percent), "x long, y long").distinct()
    x = rooted.select(F.col("group").alias("x"), F.col("node").alias("a"), F.col("root").alias("a_root"))
    y = rooted.select(F.col("group").alias("y"), F.col("node").alias("b"), F.col("root").alias("b_root"))
    pairs = found.join(x, "x").join(y, "y").where("a_root <> b_root")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _pairs_left(lists: DataFrame) -> tuple[int, int]:
    """Rows of lists, and at most how many pairs of them are of different classes."""
    alike = lists.groupBy("token", "low", "high").agg(F.count("*").alias("n"))
    closed = F.when(F.col("low") == F.col("high"), F.col("n") * F.col("n")).otherwise(F.lit(0))
    per = alike.groupBy("token").agg(F.sum("n").alias("n"), F.sum(closed).alias("same"))
    rows, pairs = per.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")).cast("double")) / 2).first()
    return rows or 0, pairs or 0


@released
def classes(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, first: Callable[[DataFrame, Callable[[bytes], int]], DataFrame] | None = None
) -> DataFrame:
    """Every row of ``docs`` as ``doc_id``, ``n_shingles``, ``component`` (a number of its class) and ``component_id``.

    Two texts are linked if their sets of distinct word shingles have a Jaccard similarity of at least ``percent``
    hundredths, exactly (shingles are 64-bit hashes); a class is all that links reach, and ``component_id`` its least
    doc_id. A text with fewer words than a shingle is one shingle; a text without words, or null, has none and is linked
    with nothing, so its component_id is its own doc_id and its component is null. Rows alike in doc_id, text or both each get a row; a
    null doc_id names a class only if no member has another; an empty table gives an empty result; further columns are
    ignored. ``first`` may name pairs of nodes (a, b) that are compared before the others; it gets the texts and the rule
    that numbers a set by its name. The result is stored, and no table with texts outlives the call.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", common.text_or_empty("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.mapInArrow(_owned(shingle), f"doc_id {kind}, name binary, size long, part int, place long, text string")
    own = stored(own.withColumn("piece", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("part")).drop("part"))
    held = own.where("text IS NOT NULL").select("piece", "place", "name", "text")
    own = own.select("doc_id", "name", "size")
    whole_sets = own.where("size > 0").groupBy("name").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
    clashes = _clashes(whole_sets)
    text_bytes = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = _prefixes(held, shingle, percent, clashes, text_bytes)
    rows = stored(rows.mapInArrow(_shared(percent), "token long, node long, group long, size int, place int"))
    lists = stored(rows.select("token", "group", "size", "place").distinct())
    members = stored(rows.select("group", "node").distinct())
    extra = None if first is None else stored(first(held, lambda name: _node(name, clashes)))
    live = members.select("node") if extra is None else members.select("node").union(extra.select("a")).union(extra.select("b"))
    texts = stored(_compared(held.select(_numbered(clashes).alias("node"), "text"), stored(live.distinct())))

    edges = stored(verified(extra, texts, shingle, percent)) if extra is not None else None
    roots = components(edges) if edges is not None else None
    stuck, tried = False, None
    for turn in range(_ROUNDS + 1):
        rooted = stored(_rooted(members, roots))
        groups = rooted.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("least"))
        now = stored(lists.join(groups, "group"))
        total, left = _pairs_left(now)
        if not left:
            break
        blocks = _blocks(now) if turn or not _ROUNDS or left <= _FEW * total else None
        last = blocks is not None and (stuck or turn == _ROUNDS or left <= _FEW * total or (
            blocks.mapInArrow(_block_pairs(percent, counted=True), "n long").agg(F.sum("n")).first()[0] or 0) <= _FEW * total)
        if last:
            pairs = _left_pairs(blocks, rooted, percent)
        else:
            hubs = stored(_hubs(now, tried, turn, percent))
            tried = hubs if tried is None else tried.union(hubs)
            pairs = _hub_pairs(hubs, rooted)
        found = stored(verified(stored(pairs), texts, shingle, percent))
        stuck = found.isEmpty()
        edges = found if edges is None else edges.union(found)
        roots = roots if stuck else components(edges)
        if last:
            break
    placed = whole_sets.withColumn("node", _numbered(clashes))
    placed = stored(_rooted(placed, roots))
    whole = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("nodes"))
    named = spread_join(placed.select("name", "rows", "root"), whole.withColumnRenamed("nodes", "rows_of"), "root", rows="rows_of")
    named = stored(named.select("name", "rows", F.col("root").alias("component"), "component_id"))
    alone = own.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    found = spread_join(own.where("size > 0"), named, "name").select("doc_id", F.col("size").alias("n_shingles"), "component", "component_id")
    return found.unionByName(alone)


def _clashes(sets: DataFrame) -> dict[bytes, int]:
    """Names that agree in their first half, with the numbers they get instead: about n²/2^65 of n, so next to none."""
    half = sets.select("name", F.substring("name", 1, 8).alias("half"))
    twice = half.groupBy("half").agg(F.count("*").alias("n"), F.collect_list("name").alias("names")).where("n > 1")
    return {bytes(x): int.from_bytes(x[8:], "little", signed=True) for r in twice.collect() for x in r["names"]}


def _numbered(clashes: dict[bytes, int]) -> Column:
    """The number of a name, as ``_node`` has it."""
    swapped = F.concat(*[F.substring("name", i, 1) for i in range(8, 0, -1)])
    number = F.conv(F.hex(swapped), 16, -10).cast("long")
    for name, other in clashes.items():
        number = F.when(F.col("name") == F.lit(name), F.lit(other)).otherwise(number)
    return number


def op11_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = classes(common.table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


#: Compares all texts that share a shingle, as strings.
OP11_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT row, doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words),
items AS MATERIALIZED (SELECT row, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS MATERIALIZED (SELECT a.row AS x, b.row AS y FROM items a JOIN items b ON a.shingle = b.shingle AND a.row <> b.row
  GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT row AS x, row AS y FROM words UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reach r ON s.row = r.x JOIN words o ON o.row = r.y GROUP BY s.row, s.doc_id, s.s
"""


common.shipped(__name__)
