"""Prefix trie of conversations, by adaptive radix trees over turn ids.

A turn's id is 16 bytes, the first of the SHA-256 of its role and text, in big-endian order; texts go no further. A
conversation is a key of such ids. Every task puts the distinct conversations that it holds into adaptive radix trees
of a bounded number of bytes, and emits what their turn-aligned depths count; a node of the trie is named by a chain of
hashes from the root, so the parts of different trees add up by name, with partial sums before the exchange. Identical
conversations are one key.

Sums over subtrees need no rounds. The least member of a node is the least of its later nodes on the member's own path,
too, so every conversation owns the last part of its path (or nothing), and the trie is cut into these parts. A part's
sums belong to its own nodes above, by a running sum, and in whole to all nodes on the path that leads to it: that path
is the key of a second round of trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plywise.llm import common, radix
from plywise.llm.common import partitions, raw, spread_join, stored

WIDTH = 16
ROOT = bytes(WIDTH)
#: Bytes of keys in one tree, rows of an emitted batch, and conversations whose numbers are joined to one string.
TREE_BYTES, ROWS, CHUNK = 8_000_000, 20_000, 20_000
#: Turns that conversations may share by construction.
HEAD = 8


def _named(column: Column) -> Column:
    return F.substring(F.unhex(F.sha2(column, 256)), 1, WIDTH)


def _name(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:WIDTH]


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, its turns' ids and UTF-8 bytes of text in order.

    The order is by turn (null first), and by id where turns are alike. A null role or text is empty. Rows without a
    conv_id belong to no conversation and make no node.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = _named(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", name.alias("id"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of c - c % 5 (none if it is absent) in place of its own first h.

    h is the CRC-32 of c in decimal, modulo 9; remainders have the sign of c.
    """
    heads = lists.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD).alias("head"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % (HEAD + 1)).cast("int")
    own = lists.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base"), "left")
    first = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.select("conv_id", F.concat(first, rest).alias("turns"))


def _keys(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Place in the batch, key and the turns' bytes of every conversation."""
    lists = batch.column("turns")
    ends = lists.offsets.to_numpy()
    turns = lists.values
    ids = raw(turns.field("id"))[1].tobytes() if len(turns) else b""
    sizes = turns.field("bytes").to_numpy(zero_copy_only=False)
    for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
        yield i, ids[WIDTH * a : WIDTH * b], sizes[a:b]


def trie_nodes(tree: radix.Tree, combine: Callable, start: object) -> Iterator[tuple[bytes, bytes | None, int, object]]:
    """Name, parent's name, depth and total of every node of the trie: the turn-aligned depths of the tree.

    ``combine`` adds two totals or values; ``start`` is the total of none.
    """
    found = list(tree.walk())
    totals = [start] * len(found)
    for i in range(len(found) - 1, -1, -1):
        above, _, _, values = found[i]
        for v in values:
            totals[i] = combine(totals[i], v)
        if above >= 0:
            totals[above] = combine(totals[above], totals[i])
    yield ROOT, None, 0, totals[0]
    names: list[tuple[bytes, bytes]] = []  # the last aligned node's name, and the bytes behind it
    for (above, depth, own, _), total in zip(found, totals):
        name, tail = names[above] if above >= 0 else (ROOT, b"")
        data = tail + own
        first = (depth - len(data)) // WIDTH
        for k in range(len(data) // WIDTH):
            parent, name = name, _name(name + data[WIDTH * k : WIDTH * (k + 1)])
            yield name, parent, first + k + 1, total
        names.append((name, data[len(data) - len(data) % WIDTH :]))


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_NODES = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()), ("n", pa.int64()), ("least", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with the conversations (``n``, ``least`` number) and the bytes of their last text, by trees of bounded size."""

    def both(x: tuple, y: tuple) -> tuple:
        return x[0] + y[0], (x if x[1] <= y[1] else y)[1], (x if x[1] <= y[1] else y)[2]

    def rows(tree: radix.Tree) -> Iterator[tuple]:
        for name, parent, depth, (n, least, sizes) in trie_nodes(tree, both, (0, float("inf"), None)):
            yield name, parent, depth, int(sizes[depth - 1]) if depth else 0, n, least

    tree, held = radix.Tree(), 0
    for batch in batches:
        n, conv = batch.column("n").to_pylist(), batch.column("conv_id").to_pylist()
        for i, key, sizes in _keys(batch):
            tree.add(key, (n[i], conv[i], sizes))
            held += len(key) + WIDTH
            if held >= TREE_BYTES:
                yield from _in_batches(rows(tree), _NODES)
                tree, held = radix.Tree(), 0
    if held:
        yield from _in_batches(rows(tree), _NODES)


_SUMS = pa.schema([("node", pa.binary()), ("saved", pa.int64()), ("leaves", pa.int64())])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of what hangs on the nodes of these paths, for all nodes on them."""

    def rows(tree: radix.Tree) -> Iterator[tuple]:
        for name, _, _, (saved, leaves) in trie_nodes(tree, lambda x, y: (x[0] + y[0], x[1] + y[1]), (0, 0)):
            yield name, saved, leaves

    tree, held = radix.Tree(), 0
    for batch in batches:
        saved, leaves = batch.column("saved").to_pylist(), batch.column("leaves").to_pylist()
        for i, key, _ in _keys(batch):
            tree.add(key, (saved[i], leaves[i]))
            held += len(key) + WIDTH
            if held >= TREE_BYTES:
                yield from _in_batches(rows(tree), _SUMS)
                tree, held = radix.Tree(), 0
    if held:
        yield from _in_batches(rows(tree), _SUMS)


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """The stretches of equal values of a sorted column, one or more for each value."""
    for batch in batches:
        values = batch.column(column).to_pylist()
        at = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[at]:
                yield values[at], batch.slice(at, i - at)
                at = i


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of a node's conversations, comma-joined in bounded chunks; ``first`` orders the chunks of a node."""
    schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("chunk", pa.string())])

    def rows() -> Iterator[tuple]:
        node, held = None, []
        for name, part in _runs(batches, "node"):
            if name != node or len(held) >= CHUNK:
                if held:
                    yield node, held[0], ",".join(map(str, held))
                node, held = name, []
            held += part.column("conv_id").to_pylist()
        if held:
            yield node, held[0], ",".join(map(str, held))

    yield from _in_batches(rows(), schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of every node, one after the other."""
    schema = pa.schema([("node", pa.binary()), ("ends", pa.string())])

    def rows() -> Iterator[tuple]:
        node, state = None, None
        for name, part in _runs(batches, "node"):
            if state is None or name != node:
                if state is not None:
                    yield node, state.hexdigest()
                node, state = name, hashlib.sha256()
            elif part.num_rows:
                state.update(b",")
            state.update(",".join(part.column("chunk").to_pylist()).encode())
        if state is not None:
            yield node, state.hexdigest()

    yield from _in_batches(rows(), schema)


def _ends(paths: DataFrame, n_convs: int) -> DataFrame:
    """``node`` and the hash of the conversations that end there.

    A hash runs through its group in order, so a group's numbers pass through one task, as chunks of joined digits that
    many tasks have written; no group is held in memory.
    """
    n = partitions(paths.sparkSession, n_convs * 32)
    chunks = paths.select("node", "conv_id").repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    chunks = chunks.mapInArrow(_joined, "node binary, first long, chunk string")
    return chunks.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of the ``rebuilt`` conversations (conv_id, turn, role, text).

    ``conv_id`` is the least member, ``parent_conv_id`` that of the parent (null at the root); ``depth``, ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes below or here), ``saved_tokens`` (bytes of last texts times the members
    but one, over the subtree) and ``ends_sha256`` of the members that end here follow. Conversations without a turn
    count at the root; an empty table has no node. Repeated rows are turns of their own; further columns are ignored. A
    conversation's turn ids are one row, whatever its length; its texts are not gathered.
    """
    lists = stored(turn_lists(conversations))
    chain = F.aggregate("turns", F.lit(ROOT), lambda acc, t: _named(F.concat(acc, t["id"])))
    paths = stored(rebuilt(lists).withColumn("node", chain))
    firsts = paths.groupBy("node").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).select("conv_id", "n")
    distinct = stored(paths.select("conv_id", "turns").join(firsts, "conv_id"))
    merged = distinct.mapInArrow(_counted, "node binary, parent binary, depth long, bytes long, n long, least long").groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("least").alias("least"))
    nodes = stored(merged)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    weighed = nodes.join(children, "node", "left").select(
        "*", F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("bytes")).alias("weight"))
    later = Window.partitionBy("least").orderBy(F.col("depth").desc())
    upto = later.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = stored(weighed.select("node", "parent", "depth", "n", "least", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                                  F.sum("weight").over(upto).alias("saved"), F.max("leaf").over(upto).alias("leaves"),
                                  F.lead("depth").over(later).isNull().alias("top")))
    tops = owned.where("top and depth > 0")
    hung = distinct.join(tops.select(F.col("least").alias("conv_id"), "depth", "saved", "leaves"), "conv_id").select(
        F.slice("turns", F.lit(1), (F.col("depth") - 1).cast("int")).alias("turns"), "saved", "leaves")
    below = hung.mapInArrow(_summed, "node binary, saved long, leaves long").groupBy("node").agg(
        F.sum("saved").alias("saved_below"), F.sum("leaves").alias("leaves_below"))
    over = owned.where("n_children > 0").select(F.col("node").alias("parent"), F.col("least").alias("parent_least"), F.col("n_children").alias("rows"))
    parents = spread_join(tops.select("node", "parent"), over, "parent").select("node", "parent_least")
    found = owned.join(below, "node", "left").join(parents, "node", "left").join(_ends(paths, paths.count()), "node", "left")
    inner = F.when(~F.col("top"), F.col("least")).otherwise(F.col("parent_least"))
    return found.select(
        F.col("least").alias("conv_id"), "depth", inner.alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        (F.col("leaves") + F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(common.table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


#: Names nodes by their whole paths, and sums over subtrees by a join of each node with the nodes above.
OP12_SQL = """
WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
own AS MATERIALIZED (SELECT conv_id, id, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS k
  FROM (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
      sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))) AS id
    FROM conversations WHERE conv_id IS NOT NULL)),
convs AS MATERIALIZED (SELECT conv_id, xor(4294967295, list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1),
    lambda i: ord(substr(conv_id::VARCHAR, i, 1))), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc),
parts AS (SELECT c.conv_id, 0 AS part, o.k, o.id, o.bytes FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.k <= c.h
  UNION ALL SELECT c.conv_id, 1, o.k, o.id, o.bytes FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h),
paths AS (SELECT conv_id, bytes, row_number() OVER w AS depth, string_agg(id, '/') OVER w AS path FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)),
members AS MATERIALIZED (SELECT conv_id, depth, bytes, sha256(path) AS node, lag(sha256(path), 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM paths
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs),
nodes AS MATERIALIZED (SELECT node, min(parent) AS parent, min(conv_id) AS conv_id, min(depth) AS depth, min(bytes) AS bytes, count(*) AS n FROM members GROUP BY node),
children AS MATERIALIZED (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (SELECT m.node, sum((n.n - 1) * n.bytes) AS saved, count(*) FILTER (c.node IS NULL) AS leaves
  FROM nodes n LEFT JOIN children c USING (node) JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.node),
ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (
  SELECT conv_id, arg_max(node, depth) AS node FROM members GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.parent = p.node LEFT JOIN children c ON n.node = c.node LEFT JOIN ends e ON n.node = e.node JOIN sums s ON n.node = s.node
"""


common.shipped(__name__)
