"""Document fingerprints by locally consistent parsing.

A text is a row of symbols, at first its bytes. On each level a run of equal symbols becomes one symbol; then every
symbol gets a label by deterministic coin tossing (Cole and Vishkin): the place of the lowest bit in which it differs
from its left neighbour, and that bit, four times over, which leaves six labels, of which neighbours are never equal.
Phrases begin at the labels' local maxima, so they have 2 to 11 symbols, and where one begins depends on a few symbols
around it only. A phrase's name is a hash of its symbols, and names are the next level's symbols. Equal substrings thus
share all names but those near their ends, at whatever offset they stand.

The fingerprint has ``BINS`` bytes, of texts of any length alike: the names of a level are dealt into the level's bins
(``SHARES``), and each bin keeps a byte of its least name's hash; an empty bin borrows from the next that has a name. The
likeness of two fingerprints estimates the Jaccard similarity of the sets of names, level by level: the share of equal
bytes, less what would be equal by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise.llm import common
from plywise.llm.common import mixed, partitions, stored
from plywise.llm.textbytes import _powers_to

BINS = 128
LEVELS = 7
#: Levels, first bin and number of bins: short texts tell themselves apart by phrases of a few bytes, long ones by long ones.
SHARES = ((range(1, 2), 0, 16), (range(2, 3), 16, 48), (range(3, LEVELS + 1), 64, 64))
_TOSSES = 4
_STEP_BYTES = 1_000_000


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5 of symbols that differ from their left neighbours; ``first`` marks each text's first symbol."""
    labels = symbols.astype(np.uint64)
    for _ in range(_TOSSES):
        left = np.concatenate([labels[:1], labels[:-1]])
        differing = np.where(first, np.uint64(1), labels ^ left)
        low = np.bitwise_count((differing & (~differing + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        labels = low << np.uint64(1) | (labels >> low) & np.uint64(1)
    return labels.astype(np.int8)


def parse(symbols: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level and each text's first one; ``firsts`` has each text's first symbol, and the end."""
    n = len(symbols)
    if not n:
        return symbols, firsts
    begins = np.zeros(n + 1, bool)
    begins[firsts] = True
    begins = begins[:n]
    # Runs of equal symbols.
    new = begins.copy()
    new[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n)).astype(np.uint64)
    runs = symbols[at]
    runs = np.where(length > 1, mixed(runs + length * np.uint64(0xD6E8FEB86659FD93)), runs)
    firsts = np.searchsorted(at, firsts)
    begins = begins[at]
    # Two different symbols may stand next to each other with one name only if their hashes are equal: then no block ends.
    labels = _labels(runs, begins)
    left = np.concatenate([labels[:1], labels[:-1]])
    right = np.concatenate([labels[1:], labels[-1:]])
    last = np.concatenate([begins[1:], [True]])
    top = (labels > left) & ((labels > right) | last) & ~begins
    starts = np.flatnonzero(top | begins)
    ends = np.append(starts[1:], len(runs))
    up, down = _powers_to(len(runs) + 1)
    sums = np.zeros(len(runs) + 1, np.uint64)
    np.cumsum(mixed(runs) * up[: len(runs)], out=sums[1:])
    names = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return names, np.searchsorted(starts, firsts)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A row of ``BINS`` bytes for each text; zeros for an empty one."""
    n = len(texts)
    firsts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    symbols = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    levels = [(symbols, firsts)]
    for _ in range(LEVELS):
        levels.append(parse(*levels[-1]))
    slots, values = [], []
    for own, start, bins in SHARES:
        for level in own:
            names, at = levels[level]
            value = mixed(names + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
            slots.append(np.repeat(np.arange(n) * BINS + start, np.diff(at)) + (value % np.uint64(bins)).astype(np.int64))
            values.append(value)
    slot, value = np.concatenate(slots), np.concatenate(values)
    least = np.full(n * BINS, np.iinfo(np.uint64).max)
    np.minimum.at(least, slot, value)
    least = least.reshape(n, BINS)
    filled = np.zeros(n * BINS, bool)
    filled[slot] = True
    twice = np.concatenate([filled.reshape(n, BINS)] * 2, axis=1)
    place = np.where(twice, np.arange(2 * BINS)[None, :], 4 * BINS)
    nearest = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    far = (nearest - np.arange(BINS)[None, :]).clip(max=BINS).astype(np.uint64)
    taken = np.take_along_axis(least, (nearest % BINS).clip(max=BINS - 1), axis=1)
    bytes_ = (mixed((taken + far * np.uint64(0xC2B2AE3D27D4EB4F)).ravel()) >> np.uint64(56)).astype(np.uint8).reshape(n, BINS)
    bytes_[~filled.reshape(n, BINS).any(axis=1)] = 0
    return bytes_


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the names behind two fingerprints (rows of bytes), 0 to 1."""
    return np.maximum(((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256), 0.0)


def edited(text: str, other: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the other's beginning, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _row(ids: list, texts: list[str], after: list[str]) -> tuple[list, np.ndarray]:
    """The rows of texts, each followed by another; and the fingerprints of the texts and of the last one's follower."""
    changed = [edited(t, o) for t, o in zip(texts, after)]
    encoded = [t.encode() for t in [*texts, after[-1]]] + [t.encode() for t in changed]
    found = fingerprints(encoded)
    n = len(texts)
    own, new = found[: n + 1], found[n + 1 :]
    return [ids, [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in encoded[n + 1 :]], [x.tobytes().hex() for x in own[:n]],
            [x.tobytes().hex() for x in new], likeness(own[:n], new).tolist(), likeness(own[:n], own[1:]).tolist()], own


_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGES = "part long, first_text string, last_text string"
_TYPES = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition; the last one, whose follower is elsewhere, only with its text and the first one's."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["doc_id", *(x.split(" ")[0] for x in f"{_COLUMNS}, {_EDGES}".split(", "))]
    first, ids, texts, size, id_type = None, [], [], 0, pa.int64()

    def rows(columns: list) -> pa.RecordBatch:
        n = len(columns[0])
        arrays = [pa.array(columns[0], id_type), *(pa.array(c, t) for c, t in zip(columns[1:], _TYPES))]
        return pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=names)

    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), common.strings(batch.column("text"))):
            text = data.decode("utf-8", "replace")
            first = text if first is None else first
            ids.append(doc_id)
            texts.append(text)
            size += len(data)
            if size >= _STEP_BYTES and len(ids) > 1:
                yield rows(_row(ids[:-1], texts[:-1], texts[1:])[0])
                ids, texts, size = ids[-1:], texts[-1:], len(data)
    if len(ids) > 1:
        yield rows(_row(ids[:-1], texts[:-1], texts[1:])[0])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids[-1:], id_type), *(pa.nulls(1, t) for t in _TYPES), pa.array([part], pa.int64()),
                                          pa.array([first]), pa.array(texts[-1:])], names=names)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of texts whose followers have come from other partitions."""
    names = ["doc_id", *(x.split(" ")[0] for x in _COLUMNS.split(", "))]
    for batch in batches:
        ids, texts, after = (batch.column(k).to_pylist() for k in ("doc_id", "text", "after"))
        for i in range(len(ids)):
            columns, _ = _row(ids[i : i + 1], texts[i : i + 1], after[i : i + 1])
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("doc_id").type),
                                              *(pa.array(c, t) for c, t in zip(columns[1:], _TYPES))], names=names)


def compared(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and their likeness and that to the next document's.

    Documents stand in ascending order of doc_id, null last, rows of equal ids in order of a hash of the text; the last
    is followed by the first, and one alone by itself. A null text is empty; empty texts have fingerprints of zeros, and
    are all alike. Texts are exchanged once, by range; only the texts at the ends of ranges are exchanged again. An empty
    table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    text = common.text_or_empty()
    total = docs.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0
    rows = docs.select("doc_id", F.col("doc_id").isNull().alias("none"), F.xxhash64(text).alias("tie"), text.alias("text"))
    order = ["none", "doc_id", "tie"]
    dealt = rows.repartitionByRange(partitions(spark, total), *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    walked = stored(dealt.mapInArrow(_walk, f"doc_id {kind}, {_COLUMNS}, {_EDGES}"))
    inner = walked.where("part IS NULL").drop("part", "first_text", "last_text")
    edges = walked.where("part IS NOT NULL")
    parts = sorted(r["part"] for r in edges.select("part").collect())  # a number for each partition
    follows = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part long, next long")
    last = edges.select("part", "doc_id", F.col("last_text").alias("text")).join(follows, "part")
    after = edges.select(F.col("part").alias("next"), F.col("first_text").alias("after"))
    outer = last.join(after, "next").select("doc_id", "text", "after").mapInArrow(_close, f"doc_id {kind}, {_COLUMNS}")
    return inner.union(outer)


def op7_parsing(spark: SparkSession, folder: str) -> DataFrame:
    return compared(common.table(spark, folder, "documents", "doc_id", "text"))


common.shipped(__name__)
