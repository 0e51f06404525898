"""Packing tokenized documents into sequences, neighbours along a space-filling curve together.

A document's vector has the counts of its tokens in hashed buckets; random signs project it to ``DIMENSIONS`` numbers,
which are placed on a grid, and the cell's number along the Hilbert curve is the document's key. Documents are sorted by
key in ranges (copies, whose keys are equal, by a hash of the row as well, so that no range holds them all), and each
range is packed in that order: documents follow one another and are cut where a sequence is full. What is left at the
end of a range fills sequences of falling powers of two, so nothing at all is padded.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise.llm import common
from plywise.llm.common import mixed, partitions, pieces, stored, strings

LENGTH = 2048
END = 1
DIMENSIONS = 4
BITS = 12
_BUCKETS = 4096
_SPREAD = 4.0


class Tokenizer:
    """Byte-level BPE from a file of ranks (token in base 64, id) at any path, and the added tokens of the description
    beside it; none is added to a text, but those that a text spells out are found in it, as they are by default."""

    def __init__(self, ranks: str, description: str, pattern: str):
        with open(ranks, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        with open(description, encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens=added)
        self.size = max(*(int(b) for _, b in pairs), *added.values()) + 1

    def __call__(self, text: str) -> list[int]:
        return self._encoding.encode(text, allowed_special="all")


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of cell coordinates (0 to 2^bits - 1), by Skilling's transposition."""
    x = [c.astype(np.int64) for c in cells.T]
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(d):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> level) & 1, turn ^ ((1 << level) - 1), turn)
    x = [v ^ turn for v in x]
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v >> level) & 1
    return key


def _signs(size: int) -> np.ndarray:
    """For each token the signs of its bucket, one for each dimension."""
    bucket = mixed(np.arange(size, dtype=np.uint64)) % np.uint64(_BUCKETS)
    bits = mixed(bucket + np.uint64(1 << 32))[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)[None, :]
    return np.where(bits & np.uint64(1), 1, -1).astype(np.int8)


def tokenized(docs: DataFrame, ranks: str | None = None, description: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id``, ``tie``, ``key`` and ``ids`` (packed numbers, the end token last) of every row; a null text is empty."""
    paths = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), description or public_tokenizers.path("byte_bpe_50k.json")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokenizer(*paths, pattern)
        signs, kind = _signs(max(tokens.size, END + 1)), _kind(tokens.size)
        for piece in pieces(batches, "text"):
            ids = [np.array([*tokens(t.decode("utf-8", "replace")), END], kind) for t in strings(piece.column("text"))]
            mean = np.array([signs[x].sum(axis=0, dtype=np.int64) / len(x) for x in ids])
            cells = np.clip((mean * _SPREAD + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("tie"), pa.array(hilbert(cells)), pa.array([kind(0).itemsize] * len(ids), pa.int32()),
                 pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "tie", "key", "width", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tie"), common.text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, tie long, key long, width int, ids binary")


def _kind(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


class _Packer:
    """Fills sequences with what comes, and tells the pieces of each full one."""

    def __init__(self, base: int):
        self.next, self.open, self.size = base, [], 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            part = ids[at : at + LENGTH - self.size]
            self.open.append((doc_id, at, part, len(ids)))
            at += len(part)
            self.size += len(part)
            if self.size == LENGTH:
                yield from self._close(self.open)
                self.open, self.size = [], 0

    def end(self) -> Iterator[tuple]:
        """Sequences of falling powers of two from what is left."""
        while self.size:
            length = 1 << (self.size.bit_length() - 1)
            own, room = [], length
            while room:
                doc_id, start, ids, total = self.open.pop(0)
                own.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    self.open.insert(0, (doc_id, start + room, ids[room:], total))
                room -= len(own[-1][2])
            self.size -= length
            yield from self._close(own)

    def _close(self, own: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in own:
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset
            offset += len(ids)
        self.next += 1


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, ranks: str | None = None, description: str | None = None, pattern: str | None = None) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Every row is a document of its own, whatever its doc_id; a null or empty text has the end token alone; an empty
    table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = stored(tokenized(docs, ranks, description, pattern))
    total = rows.agg(F.sum(F.octet_length("ids") + 32)).first()[0] or 0
    order = ["key", "tie", "doc_id"]
    dealt = rows.repartitionByRange(partitions(spark, total), *order).sortWithinPartitions(*order)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split(" ")[0] for x in _PIECE.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack = _Packer(TaskContext.get().partitionId() << 40)

        def sent(found: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        id_type = pa.int64()
        for batch in batches:
            id_type, found = batch.schema.field("doc_id").type, []
            for doc_id, width, ids in zip(batch.column("doc_id").to_pylist(), batch.column("width").to_pylist(), strings(batch.column("ids"))):
                found.extend(pack.add(doc_id, np.frombuffer(ids, np.uint16 if width == 2 else np.uint32)))
            yield sent(found, id_type)
        yield sent(list(pack.end()), id_type)

    return dealt.select("doc_id", "width", "ids").mapInArrow(run, f"doc_id {kind}, {_PIECE}")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(common.table(spark, folder, "documents", "doc_id", "text"))


common.shipped(__name__)
