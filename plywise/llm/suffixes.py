"""Exact removal of repeated passages by suffix order, built column by column for many short documents.

Any string of ``LENGTH`` bytes holds an anchor: the place of its least hash among its ``GRAM``-byte substrings, leftmost
if there are several. The anchor depends on the string alone, so equal strings, wherever they stand, have equal anchors
at equal places, and strings need to be compared only with those of the same anchor. A text is thus cut into contexts,
one for each anchor: the bytes of all strings (some consecutive starts) that have it.

1. Tasks find the contexts of their texts, and exchange only hashes, by anchor. A context that was seen before, byte for
   byte (128 bits of hash), is repeated in whole. Each task first does so with its own, so that a passage in very many
   texts leaves a task once.
2. Anchors with several different contexts are left: edges of repeated passages. The bytes of these contexts are
   fetched, and are the documents of collections whose Burrows-Wheeler transform is built by Bauer, Cox and Rosone's
   method: each round inserts one symbol of every document, from its end backwards, at the place that the transform so
   far gives (rank of the symbol before it), and updates the longest common prefixes with both neighbours from the
   minimum over the range between equal symbols. Each round reads the transform and the prefixes in sequence and writes
   them anew. Runs with common prefixes of ``LENGTH`` or more are equal strings; all but the earliest are repeated.
3. An anchor with very many contexts is cut into collections of ``GROUP`` contexts; the earliest of each run then meet
   the others by the hash of their string (128 bits).
4. Intervals of repeated strings go to their texts, which lose the bytes.

A collection holds a bounded number of bytes, so its transform needs no file of its own: what passes between the rounds
is an array, and what is larger than a task is in Spark's exchanges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plywise.llm import common
from plywise.llm.common import blobs, mixed, partitions, pieces, raw, stored, unpacked
from plywise.llm.textbytes import SpanHash

LENGTH = 100
GRAM = 28
#: Most contexts of an anchor in one collection; most that a task sends to the anchor's bucket; bytes in a collection.
GROUP = 2_048
LOCAL = 16
COLLECTION_BYTES = 500_000
_FLUSH = 250_000
_MIN_BUCKETS = 1024
_HEAD, _REPEATED, _HOT, _ASKED = 0, 1, 2, 3
_BLOB = {"g": np.uint64, "h": np.uint32, "o": np.int64, "th": np.int64, "lo": np.uint32, "n": np.uint32, "mode": np.uint8}
_NO_ID = (1 << 63) - 1


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that stand one after another: first and last start of each context, hash of its anchor and of itself."""
    none = np.zeros(0, np.int64)
    width = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    span = SpanHash(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = span(at, at + GRAM)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int64)  # starts of strings that end within their text
    sizes = np.diff(offsets)
    long = sizes >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    own = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1) | np.isin(starts[1:], offsets)
    first = np.flatnonzero(new)
    lo, hi = starts[first], starts[np.concatenate([first[1:], [len(starts)]]) - 1]
    a = own[first]
    whole = mixed(span(lo, hi + LENGTH) + mixed((a - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)) * np.uint64(3))
    return lo, hi, grams[a], whole


class _Outbox:
    """What a task has found and not yet sent: contexts, with the order of their texts."""

    def __init__(self, n_buckets: int, salt: int):
        self.n_buckets, self.salt, self.parts, self.size = n_buckets, salt, [], 0

    def add(self, o: np.ndarray, th: np.ndarray, lo: np.ndarray, n: np.ndarray, h: np.ndarray, g: np.ndarray) -> None:
        self.parts.append((o, th, lo, n, h, g))
        self.size += len(o)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        o, th, lo, n, h, g = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size, self.salt = [], 0, self.salt + 1
        order = np.lexsort((lo, th, o))
        o, th, lo, n, h, g = (x[order] for x in (o, th, lo, n, h, g))
        order = np.argsort(g, kind="stable")
        again = np.zeros(len(g), bool)
        again[order[1:]] = (g[order[1:]] == g[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
        # Repeated here: consecutive contexts of a text become one interval.
        ro, rt, rl, rn = o[again], th[again], lo[again], n[again]
        apart = np.ones(len(ro), bool)
        apart[1:] = (ro[1:] != ro[:-1]) | (rt[1:] != rt[:-1]) | (rl[1:] > rl[:-1] + rn[:-1] + 1)
        first = np.flatnonzero(apart)
        last = np.concatenate([first[1:], [len(ro)]]) - 1
        last = last[: len(first)]
        ro, rt, rn, rl = ro[first], rt[first], rl[last] + rn[last] - rl[first], rl[first]
        zero = np.zeros(len(ro), np.uint64)
        out = [self._rows(zero, zero, ro, rt, rl, rn, _REPEATED, mixed(ro.view(np.uint64)))]
        o, th, lo, n, h, g = (x[~again] for x in (o, th, lo, n, h, g))
        kinds, place, count = np.unique(h, return_inverse=True, return_counts=True)
        crowded = count[place] > LOCAL
        nothing = np.zeros(int((count > LOCAL).sum()), np.int64)
        hot = kinds[count > LOCAL]
        out.append(self._rows(hot, hot, nothing, nothing, nothing, nothing, _HOT, mixed(hot)))
        asked = [x[crowded] for x in (o, th, lo, n)]
        number = (_number(h[crowded]) // GROUP).astype(np.uint64)
        key = mixed(h[crowded] + mixed(np.uint64(self.salt) << np.uint64(20) | number))
        out.append(self._rows(key, key, *asked, _ASKED, mixed(asked[0].view(np.uint64))))
        out.append(self._rows(*(x[~crowded] for x in (g, h, o, th, lo, n)), _HEAD, mixed(h[~crowded])))
        columns = {k: np.concatenate([x[k] for x in out]) for k in out[0]}
        yield blobs((columns.pop("by") % np.uint64(self.n_buckets)).astype(np.int64), self.n_buckets,
                    **{k: columns[k].astype(v) for k, v in _BLOB.items()})

    @staticmethod
    def _rows(g, h, o, th, lo, n, mode: int, by: np.ndarray) -> dict[str, np.ndarray]:
        # Of an anchor's hash the exchange keeps 32 bits besides the bucket: a chance meeting costs a comparison only.
        return {"g": g, "h": h >> np.uint64(32), "o": o, "th": th, "lo": lo, "n": n, "mode": np.full(len(g), mode, np.uint8), "by": by}


def _number(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    first = np.flatnonzero(new)
    found = np.empty(len(keys), np.int64)
    found[order] = np.arange(len(keys)) - np.repeat(first, np.diff(np.concatenate([first, [len(keys)]])))
    return found


def _cut(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        box = _Outbox(n_buckets, TaskContext.get().partitionId() << 12)
        for piece in pieces(batches, "text"):
            offsets, data = raw(piece.column("text"))
            lo, hi, h, g = contexts(data, offsets)
            row = np.searchsorted(offsets, lo, side="right") - 1
            o, th = (piece.column(k).to_numpy(zero_copy_only=False)[row] for k in ("o", "th"))
            box.add(o, th, lo - offsets[row], hi - lo, h, g)
            if box.size >= _FLUSH:
                yield from box.flush()
        yield from box.flush()

    return run


_FOUND = "kind int, o long, th long, lo long, n long, key long, big boolean"


def _found(kind: int, o, th, lo, n, key=None, big=None) -> pa.RecordBatch:
    size = len(o)
    key = np.zeros(size, np.int64) if key is None else key.view(np.int64)
    big = np.zeros(size, bool) if big is None else big
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, kind, np.int32)), pa.array(o), pa.array(th), pa.array(lo.astype(np.int64)), pa.array(n.astype(np.int64)),
         pa.array(key), pa.array(big)], names=[x.split(" ")[0] for x in _FOUND.split(", ")])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: starts lo to lo + n are repeated. Kind 1: the context is to be compared, in the collection of its key."""
    x = unpacked(batches, **_BLOB)
    mode = x.pop("mode")
    own = mode == _REPEATED
    yield _found(0, x["o"][own], x["th"][own], x["lo"][own], x["n"][own])
    own = mode == _ASKED
    yield _found(1, x["o"][own], x["th"][own], x["lo"][own], x["n"][own], x["g"][own], np.ones(own.sum(), bool))
    hot = np.unique(x["h"][mode == _HOT])
    own = mode == _HEAD
    x = {k: v[own] for k, v in x.items()}
    order = np.lexsort((x["lo"], x["th"], x["o"], x["g"], x["h"]))
    x = {k: v[order] for k, v in x.items()}
    again = np.zeros(len(order), bool)
    again[1:] = (x["g"][1:] == x["g"][:-1]) & (x["h"][1:] == x["h"][:-1])
    yield _found(0, x["o"][again], x["th"][again], x["lo"][again], x["n"][again])
    x = {k: v[~again] for k, v in x.items()}
    _, place, count = np.unique(x["h"], return_inverse=True, return_counts=True)
    hot = np.isin(x["h"], hot)
    ask = (count[place] > 1) | hot
    big = (count[place] > GROUP) | hot
    key = mixed(x["h"].astype(np.uint64) << np.uint64(24) | (_number(x["h"]) // GROUP).astype(np.uint64))
    yield _found(1, x["o"][ask], x["th"][ask], x["lo"][ask], x["n"][ask], key[ask], big[ask])


def transform(codes: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform and longest common prefixes of a collection of documents.

    ``codes`` holds the symbols (1 and up), ``ends`` where each document ends. 0 stands for a document's end, and sorts
    by document. Round j inserts the suffixes of j symbols, by the symbol before each (0 before a whole document).
    """
    m = len(ends)
    bwt = codes[ends - 1].copy()
    prefix = np.zeros(m, np.uint8)
    at, doc = np.arange(m), np.arange(m)
    for j in range(1, int(sizes.max(initial=0)) + 1):
        n, symbol = len(bwt), bwt[at]
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        rank = rank[at]
        before, after = order[np.maximum(rank - 1, 0)], order[np.minimum(rank + 1, n - 1)]
        has_before = (rank > 0) & (bwt[before] == symbol)
        has_after = (rank < n - 1) & (bwt[after] == symbol)
        padded = np.append(prefix, np.uint8(0))
        with_before = np.zeros(len(at), np.uint8)
        with_before[has_before] = _least(padded, before[has_before] + 1, at[has_before] + 1) + 1
        with_after = np.zeros(len(at), np.uint8)
        with_after[has_after] = _least(padded, at[has_after] + 1, after[has_after] + 1) + 1
        place = m + rank.astype(np.int64) - int(np.count_nonzero(bwt == 0))
        old = np.ones(n + len(at), bool)
        old[place] = False
        grown, longer = np.empty(n + len(at), bwt.dtype), np.empty(n + len(at) + 1, np.uint8)
        grown[old], longer[:-1][old] = bwt, prefix
        longer[place + 1] = with_after
        longer[place] = with_before
        more = sizes[doc] > j
        grown[place] = np.where(more, codes[ends[doc] - 1 - np.minimum(j, sizes[doc] - 1)], 0)
        bwt, prefix, at, doc = grown, longer[:-1], place[more], doc[more]
    return bwt, prefix


def _least(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Minima of the ranges from start to before stop."""
    if not len(starts):
        return np.zeros(0, values.dtype)
    order = np.argsort(starts, kind="stable")
    found = np.empty(len(starts), values.dtype)
    found[order] = np.minimum.reduceat(values, np.stack([starts[order], stops[order]], axis=1).ravel())[::2]
    return found


def equal_strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of ``LENGTH`` bytes in a collection: document, place in it, and a number that equal strings share."""
    used = np.zeros(256, bool)
    used[data] = True
    kinds = np.cumsum(used)
    codes = kinds[data].astype(np.uint8 if kinds[-1] < 256 else np.uint16)
    bwt, prefix = transform(codes, starts + sizes, sizes)
    run = np.cumsum(prefix < LENGTH)
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), np.int64)
    rank[order] = np.arange(len(bwt))
    m, ended = len(starts), int(np.count_nonzero(bwt == 0))
    at, doc = np.arange(m), np.arange(m)
    found = []
    for j in range(1, int(sizes.max(initial=0)) + 1):
        live = sizes[doc] >= j
        doc, at = doc[live], m + rank[at[live]] - ended
        if j >= LENGTH:
            found.append((doc, sizes[doc] - j, run[at]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _fetch(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            offsets, data = raw(piece.column("text"))
            asked = piece.column("asked")
            per = np.diff(np.asarray(asked.offsets))
            rows = asked.flatten()
            lo, n, key = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "n", "key"))
            big = rows.field("big").to_numpy(zero_copy_only=False).astype(np.uint8)
            row = np.repeat(np.arange(piece.num_rows), per)
            o, th = (piece.column(k).to_numpy(zero_copy_only=False)[row] for k in ("o", "th"))
            size = n + LENGTH
            bucket = (mixed(key.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            fixed = blobs(bucket, n_buckets, key=key, o=o, th=th, lo=lo, size=size, big=big)
            begin, size = (offsets[row] + lo)[order], size[order]
            stop = np.cumsum(size)
            text = data[np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
            counts = np.cumsum(np.bincount(bucket, minlength=n_buckets))[fixed.column("bucket").to_numpy()]
            edges = np.concatenate([[0], stop])[np.concatenate([[0], counts])].tolist()
            yield pa.RecordBatch.from_arrays([*fixed.columns, pa.array([text[a:b] for a, b in zip(edges, edges[1:])], pa.binary())],
                                             names=[*fixed.schema.names, "bytes"])

    return run


_COMPARED = "o long, th long, lo long, n long, string binary"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated starts; with ``string`` (a hash) the earliest ones of an anchor that has more collections."""
    kinds = {"key": np.int64, "o": np.int64, "th": np.int64, "lo": np.int64, "size": np.int64, "big": np.uint8, "bytes": np.uint8}
    x = unpacked(batches, **kinds)
    data = x.pop("bytes")
    begin = np.cumsum(x["size"]) - x["size"]
    order = np.argsort(x["key"], kind="stable")
    x, begin = {k: v[order] for k, v in x.items()}, begin[order]
    n = len(begin)
    cuts = np.flatnonzero(np.concatenate([[True], x["key"][1:] != x["key"][:-1]])) if n else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(x["size"])])
    a = 0
    while a < n:
        b = int(np.searchsorted(total, total[a] + COLLECTION_BYTES, side="right")) - 1
        b = int(cuts[np.searchsorted(cuts, b, side="right") - 1]) if b < n else n
        if b <= a:
            later = cuts[cuts > a]
            b = int(later[0]) if len(later) else n
        part = {k: v[a:b] for k, v in x.items()}
        stop = np.cumsum(part["size"])
        own = data[np.repeat(begin[a:b] - (stop - part["size"]), part["size"]) + np.arange(stop[-1])]
        doc, off, run = equal_strings(own, stop - part["size"], part["size"])
        start = part["lo"][doc] + off
        order = np.lexsort((start, part["th"][doc], part["o"][doc], run))
        doc, off, run, start = doc[order], off[order], run[order], start[order]
        again = np.zeros(len(run), bool)
        again[1:] = run[1:] == run[:-1]
        o, th = part["o"][doc], part["th"][doc]
        # Consecutive starts as one interval.
        order = np.lexsort((start[again], th[again], o[again]))
        ro, rt, rs = o[again][order], th[again][order], start[again][order]
        apart = np.ones(len(ro), bool)
        apart[1:] = (ro[1:] != ro[:-1]) | (rt[1:] != rt[:-1]) | (rs[1:] > rs[:-1] + 1)
        first = np.flatnonzero(apart)
        last = (np.concatenate([first[1:], [len(ro)]]) - 1)[: len(first)]
        yield pa.RecordBatch.from_arrays([pa.array(ro[first]), pa.array(rt[first]), pa.array(rs[first]), pa.array(rs[last] - rs[first]),
                                          pa.nulls(len(first), pa.binary())], names=["o", "th", "lo", "n", "string"])
        open_ = ~again & (part["big"][doc] == 1)
        base = (stop - part["size"])[doc[open_]] + off[open_]
        text = own.tobytes()
        hashes = [xxhash.xxh3_128_digest(text[i : i + LENGTH]) for i in base.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(o[open_]), pa.array(th[open_]), pa.array(start[open_]), pa.array(np.zeros(len(base), np.int64)),
                                          pa.array(hashes, pa.binary())], names=["o", "th", "lo", "n", "string"])
        a = b


def repeats(keyed: DataFrame, total_bytes: int) -> DataFrame:
    """Intervals (o, th, lo, n): the strings that start at lo to lo + n are repeated. ``keyed`` has o, th and text.

    ``o`` and ``th`` order the texts, and no two rows have both alike.
    """
    spark = keyed.sparkSession
    n = partitions(spark, total_bytes // ((LENGTH - GRAM + 2) // 2) * 30)
    n_buckets = max(_MIN_BUCKETS, 4 * n)
    schema = "bucket int, " + ", ".join(f"{k} binary" for k in _BLOB)
    cut = keyed.mapInArrow(_cut(n_buckets), schema)
    met = stored(cut.repartition(n, "bucket").drop("bucket").mapInArrow(_meet, _FOUND))
    asked = met.where("kind = 1")
    n_asked = asked.agg(F.sum(F.col("n") + LENGTH)).first()[0] or 0
    asked = asked.groupBy("o", "th").agg(F.collect_list(F.struct("lo", "n", "key", "big")).alias("asked"))
    n = partitions(spark, n_asked, 4_000_000)
    n_buckets = max(_MIN_BUCKETS, 4 * n)
    schema = "bucket int, key binary, o binary, th binary, lo binary, size binary, big binary, bytes binary"
    fetched = keyed.join(asked, ["o", "th"]).mapInArrow(_fetch(n_buckets), schema)
    compared = stored(fetched.repartition(n, "bucket").drop("bucket").mapInArrow(_compare, _COMPARED))
    place = F.row_number().over(W.partitionBy("string").orderBy("o", "th", "lo"))
    later = compared.where("string IS NOT NULL").withColumn("place", place).where("place > 1")
    columns = ["o", "th", "lo", "n"]
    return met.where("kind = 0").select(columns).union(compared.where("string IS NULL").select(columns)).union(later.select(columns))


_KEPT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _form(left: bytes, form: str) -> bytes:
    if form == "sha256":
        return hashlib.sha256(left).hexdigest().encode()
    return left.decode("utf-8", "ignore").encode() if form == "text" else left


def _without(batches: Iterator[pa.RecordBatch], columns: list[str], form: str) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        texts = common.strings(piece.column("text"))
        rows: list[list] = [[], [], [], []]
        for text, found in zip(texts, piece.column("found").to_pylist()):
            kept, at, removed, spans = [], 0, 0, 0
            for lo, stop in _merged(found or []):
                kept.append(text[at:lo])
                removed, spans, at = removed + stop - lo, spans + 1, stop
            kept.append(text[at:])
            left = b"".join(kept)
            for k, v in enumerate((len(text), removed, spans, _form(left, form))):
                rows[k].append(v)
        arrays = [pa.array(v, pa.int64()) for v in rows[:3]] + [pa.array(rows[3], pa.binary())]
        yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in columns), *arrays], names=[*columns, *(x.split(" ")[0] for x in _KEPT.split(", "))])


def _merged(found: list[dict]) -> list[tuple[int, int]]:
    """Bytes that the strings cover, as maximal runs."""
    runs: list[list[int]] = []
    for lo, n in sorted((r["lo"], r["n"]) for r in found):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], lo + n + LENGTH)
        else:
            runs.append([lo, lo + n + LENGTH])
    return [(a, b) for a, b in runs]


def deduplicated(docs: DataFrame, carried: list[str], form: str = "bytes") -> DataFrame:
    """``carried`` columns, n_bytes, n_removed, n_spans and ``kept``: what is left of the text.

    That is ``bytes``, their ``sha256`` in hex, or ``text``, where a character of which a byte is cut goes as a whole.

    Strings of ``LENGTH`` bytes that also start earlier are removed, wherever they overlap. Texts are ordered by doc_id,
    null last, then by hash of the text; of rows alike in both, one is the first and the others are its copies. Null
    and empty texts have no bytes; texts shorter than ``LENGTH`` stay whole; an empty table gives an empty result.
    ``carried`` columns must be a function of doc_id and text where rows are alike in both.
    """
    # One pass over the ids tells whether they order the texts by themselves, as they usually do.
    text = common.text_or_empty()
    facts = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.sum(F.octet_length(text)).alias("bytes")).first()
    alone = facts["n"] == facts["ids"]
    th = F.lit(0).cast("long") if alone else F.xxhash64(text)
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).cast("long").alias("o"), th.alias("th"), text.alias("text"),
                        F.struct(*carried).alias("carried"))
    if not alone:
        keyed = stored(keyed.groupBy("o", "th").agg(F.min("text").alias("text"), F.min("carried").alias("carried"), F.count("*").alias("rows")))
    else:
        keyed = keyed.withColumn("rows", F.lit(1).cast("long"))
    found = repeats(keyed.select("o", "th", "text"), facts["bytes"] or 0)
    found = found.groupBy("o", "th").agg(F.collect_list(F.struct("lo", "n")).alias("found"))
    joined = keyed.join(found, ["o", "th"], "left").select("text", "carried", "rows", "found")
    schema = f"carried {keyed.schema['carried'].dataType.simpleString()}, rows long, {_KEPT}"
    done = joined.mapInArrow(lambda it: _without(it, ["carried", "rows"], form), schema)
    if not alone:
        done = done.withColumn("copy", F.explode(F.expr("sequence(1L, rows)"))).withColumns(_of_copies(form))
    return done.select("carried.*", "n_bytes", "n_removed", "n_spans", "kept")


def _of_copies(form: str) -> dict[str, Column]:
    """A row that repeats another in whole loses all its bytes, if a string fits in it; one that was cut itself, too."""
    gone = (F.col("copy") > 1) & (F.col("n_bytes") >= LENGTH)
    empty = F.lit(_form(b"", form).decode()).cast("binary")
    return {"n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")),
            "n_spans": F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")),
            "kept": F.when(gone, empty).otherwise(F.col("kept"))}


def op10_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    found = deduplicated(common.table(spark, folder, "documents", "doc_id", "text"), ["doc_id"], "sha256")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


common.shipped(__name__)
