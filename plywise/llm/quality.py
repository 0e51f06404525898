"""Quality rules: fixed rules on counts, and a logistic regression on hashed word and character n-grams.

The features of a text are the frequencies of its words, word pairs and 4-byte sequences in hashed buckets, so a
text of any length costs one lookup for each n-gram and no memory of its own. The model is fitted on at most
``SAMPLE`` labelled rows (those with the least hash of doc_id), calibrated on the fifth of them that the fit did not see
(Platt's logistic function of the raw score), and applied to Arrow batches of whole texts. Nothing else is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise.llm import common
from plywise.llm.common import pieces, raw, stored
from plywise.llm.textbytes import SPACES, SpanHash, spans, sums

#: Most labelled rows that the fit sees.
SAMPLE = 2_000
BUCKETS = 1 << 16
KEEP = 0.5
MIN_WORDS = 10
WINDOW = 5
MOST_REPEATED = 0.2
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_GRAMS = (4,)


class Texts:
    """The words of some texts, and hashes of any of their spans."""

    def __init__(self, column: pa.Array):
        self.n = len(column)
        self.offsets, self.data = raw(column)
        self.hash = SpanHash(self.data)
        self.starts, self.ends, self.firsts = spans(self.data, self.offsets, SPACES)
        self.words = self.hash(self.starts, self.ends)
        self.of = np.repeat(np.arange(self.n), np.diff(self.firsts))


def _mark(of: np.ndarray) -> np.ndarray:
    return common.mixed(of.astype(np.uint64) + np.uint64(1))


def counts(texts: Texts) -> dict[str, np.ndarray]:
    """The base statistics of every text; see ``base``."""
    data, of = texts.data, texts.of
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    inner = sums(points[texts.ends] - points[texts.starts], texts.firsts)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])[texts.offsets]
    # Lines: a line break parts them as the end of a text does.
    stops = np.union1d(np.flatnonzero(data == 10) + 1, texts.offsets[1:]) if texts.n else np.zeros(0, np.int64)
    begins = np.union1d(texts.offsets[:-1], np.flatnonzero(data == 10) + 1)
    begins, stops = begins[begins < len(data)], stops[stops > 0]
    closed = stops - ((data[stops - 1] == 10) if len(data) else 0)
    worded = np.searchsorted(texts.starts, begins) < np.searchsorted(texts.starts, closed)
    begins, closed = begins[worded], closed[worded]
    line_of = np.searchsorted(texts.offsets, begins, side="right") - 1
    marks = texts.hash(begins, closed) ^ _mark(line_of)
    order = np.argsort(marks, kind="stable")
    again = np.zeros(len(marks), bool)
    again[order[1:]] = marks[order[1:]] == marks[order[:-1]]
    # Words in windows of five that a text has twice or more.
    covered = np.zeros(len(of) + 1, np.int64)
    if len(of) >= WINDOW:
        inside = of[WINDOW - 1 :] == of[: 1 - WINDOW]
        window = np.zeros(len(inside), np.uint64)
        for k in range(WINDOW):
            window = common.mixed(window * np.uint64(31) + texts.words[k : k + len(inside)])
        at = np.flatnonzero(inside)
        window = window[at] ^ _mark(of[at])
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    repeated = sums((np.cumsum(covered)[:-1] > 0).astype(np.int64), texts.firsts)
    return dict(zip(_BASE, (np.diff(texts.firsts), inner, np.diff(symbols), np.bincount(line_of[again], minlength=texts.n), repeated)))


def _bucket(hashes: np.ndarray, salt: int) -> np.ndarray:
    return ((hashes + np.uint64(salt)) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(48)


def grams(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features: for each, the buckets of all its n-grams and the place of each text's first."""
    yield _bucket(texts.words, 1), texts.firsts
    pair = np.flatnonzero(texts.of[1:] == texts.of[:-1])
    both = texts.words[pair] * np.uint64(0x9E3779B97F4A7C15) + texts.words[pair + 1]
    yield _bucket(both, 2), np.searchsorted(texts.of[pair], np.arange(texts.n + 1))
    for n in _GRAMS:
        size = max(len(texts.data) - n + 1, 0)
        gram = np.zeros(size, np.uint64)
        for k in range(n):
            gram = gram << np.uint64(8) | texts.data[k : k + size]
        whole = np.ones(size, bool)
        for k in range(1, n):  # none goes over the end of its text
            whole[(texts.offsets[1:-1] - k).clip(0, max(size - 1, 0))] &= (texts.offsets[1:-1] - k < 0) | (texts.offsets[1:-1] - k >= size)
        firsts = np.concatenate([[0], np.cumsum(whole)])[np.minimum(texts.offsets, size)]
        yield _bucket(gram[whole], n), firsts


def raw_scores(texts: Texts, weights: np.ndarray) -> np.ndarray:
    """The sum over the kinds of features of the mean weight of a text's n-grams."""
    total = np.zeros(texts.n)
    for kind, (buckets, firsts) in enumerate(grams(texts)):
        total += sums(weights[kind][buckets], firsts) / np.maximum(np.diff(firsts), 1)
    return total


@dataclass(frozen=True)
class Model:
    """Weights by kind of feature and bucket, and the calibration: P(good) = 1 / (1 + exp(-(slope raw + shift)))."""

    weights: np.ndarray
    slope: float
    shift: float

    def judged(self, text: str | Column = "text") -> Column:
        """A struct of the base statistics and ``quality``, the calibrated probability."""
        model = self

        @F.arrow_udf("struct<" + ",".join(f"{k}:long" for k in _BASE) + ",quality:double>")
        def run(column: pa.Array) -> pa.Array:
            found = []
            for piece in pieces([pa.RecordBatch.from_arrays([column], names=["text"])], "text"):
                texts = Texts(piece.column("text"))
                z = np.clip(model.slope * raw_scores(texts, model.weights) + model.shift, -500, 500)
                arrays = [pa.array(v.astype(np.int64)) for v in counts(texts).values()] + [pa.array(1 / (1 + np.exp(-z)))]
                found.append(pa.StructArray.from_arrays(arrays, names=[*_BASE, "quality"]))
            return pa.concat_arrays(found)

        return run(F.col(text) if isinstance(text, str) else text)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        texts = Texts(piece.column("text"))
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(texts.n)]
        for kind, (buckets, firsts) in enumerate(grams(texts)):
            for d in range(texts.n):
                at, n = np.unique(buckets[firsts[d] : firsts[d + 1]], return_counts=True)
                parts[d].append((at + kind * BUCKETS, n / max(1, n.sum())))
        yield pa.RecordBatch.from_arrays(
            [piece.column("good"), piece.column("held"),
             pa.array([np.concatenate([a for a, _ in p]).astype(np.int32).tobytes() for p in parts], pa.binary()),
             pa.array([np.concatenate([v for _, v in p]).astype(np.float32).tobytes() for p in parts], pa.binary())],
            names=["good", "held", "at", "values"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model; without labels of both kinds every text has the probability one half."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = stored(known.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``sample`` rows
    rows = rows.groupBy("doc_id", "good", "held").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(_features, "good int, held boolean, at binary, values binary").collect()
    weights = np.zeros((2 + len(_GRAMS), BUCKETS), np.float32)
    good = np.array([r["good"] for r in got], float)
    held = np.array([r["held"] for r in got], bool)
    if len(set(good[~held])) < 2:
        return Model(weights, 0.0, 0.0)
    sizes = np.array([len(r["at"]) // 4 for r in got])
    at = np.concatenate([np.frombuffer(r["at"], np.int32) for r in got])
    values = np.concatenate([np.frombuffer(r["values"], np.float32) for r in got])
    del got
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    flat, shift = _descent(at, values, firsts, good, ~held)
    z = sums(flat[at] * values, firsts) + shift
    own = held if len(set(good[held])) == 2 else ~held
    slope, offset = _platt(z[own], good[own])
    return Model(flat.reshape(weights.shape).astype(np.float32), slope, slope * shift + offset)


def _descent(at: np.ndarray, values: np.ndarray, firsts: np.ndarray, good: np.ndarray, use: np.ndarray,
             steps: int = 60, rate: float = 1.0, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by Adagrad over all rows of ``use``; frequencies are small, so the weights may grow large."""
    width = (2 + len(_GRAMS)) * BUCKETS
    w, seen, bias, bias_seen = np.zeros(width), np.full(width, 1e-8), 0.0, 1e-8
    of = np.repeat(np.arange(len(good)), np.diff(firsts))
    weight = use / use.sum()
    for _ in range(steps):
        z = sums(w[at] * values, firsts) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good)
        g = np.bincount(at, error[of] * values, minlength=width) + ridge * w / width
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        b = error.sum()
        bias_seen += b * b
        bias -= 0.1 * b / np.sqrt(bias_seen)
    return w, float(bias)


def _platt(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated probability, by Newton steps; targets are smoothed as Platt proposed."""
    n1, n0 = good.sum(), (1 - good).sum()
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(z.std(), 1e-9)
    design, beta = np.stack([z / scale, np.ones_like(z)]), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)) @ design.T + 1e-6 * np.eye(2), design @ (target - p))
        beta += step / max(1.0, np.abs(step).max())
    return float(beta[0] / scale), float(beta[1])


def base_failed(n_words: str | Column = "n_words", repeated: str | Column = "n_repeat_words") -> Column:
    """The fixed rules: fewer words than ``MIN_WORDS``, or more than a fifth of the words in repeated windows."""
    n_words, repeated = (F.col(x) if isinstance(x, str) else x for x in (n_words, repeated))
    return (n_words < MIN_WORDS) | (repeated * 100 > n_words * round(100 * MOST_REPEATED))


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``quality`` and ``kept`` of every row.

    A null text has no words and fails the base rules, as an empty one does. Rows with equal ids or texts are judged
    each by itself; further columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, sample)
    rows = docs.select("doc_id", model.judged(common.text_or_empty()).alias("s")).select("doc_id", "s.*")
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judged(common.table(spark, folder, "documents", "doc_id", "text"), common.table(spark, folder, "labels", "doc_id", "quality"))


common.shipped(__name__)
