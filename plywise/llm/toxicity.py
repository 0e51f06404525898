"""Toxic passages by maximum-scoring segments.

A token is a whole word in lower case (A-Z), whatever its length; of scripts that don't part words it is a pair of
neighbouring characters. Every token has a score: the log-odds of the toxic against the other labelled documents, with a Dirichlet prior, less
two standard deviations, so that a rare token never counts for toxic by chance. A linear scan finds all maximal segments
of a text (Ruzzo and Tompa); only tokens that score above zero and the sums of the gaps between them enter it. A token
that repeats the one before it scores no more than a gap, so one word said over and over is no passage. The score
S of the best segment of n tokens is calibrated by its extreme-value law: under the background (the token frequencies of
documents labelled not toxic) the number of segments that score S or more is about E = K n exp(-lambda S), where lambda
solves sum p exp(lambda s) = 1 and K is fitted to all background documents. The document's probability is a logistic
function of log E, fitted to all labelled rows in bins of log E.

Counts are document frequencies over all labelled rows (held-out rows excepted), in 2^20 hashed buckets: a table
of fixed size, whatever the corpus. Null and empty texts have no token and no segment, and get the probability of the
labelled documents without a toxic token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise.llm import common
from plywise.llm.common import blobs, pieces, raw, stored, unpacked
from plywise.llm.textbytes import LOWER, PUNCTUATION, SpanHash, spans

BUCKETS = 1 << 20
_SLICES = 64
PRIOR = 0.5
DEVIATIONS = 2.0
FLOOR = 0.05
FOLDS = 5
#: A passage counts as significant if fewer than this many as good are expected in a text of its length.
SIGNIFICANT = 0.01
_STATS = "n_tokens long, best double, n_segments long, starts array<int>, ends array<int>, scores array<double>"


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether labels of this row may not be learned from; true for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % FOLDS == 0, F.lit(True))


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Where characters begin of scripts that don't part words: Chinese, Japanese, Thai, Lao, Khmer, Burmese."""
    at = np.flatnonzero(data >= 0xE0)
    lead, second = data[at], data[np.minimum(at + 1, len(data) - 1)]
    han = (lead >= 0xE3) & (lead <= 0xE9) | (lead == 0xF0) & (second >= 0xA0) & (second <= 0xB3)
    thai = (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
    khmer = (lead == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second >= 0x9E) & (second <= 0x9F))
    return at[han | thai | khmer]


def _cut(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs, where those of scripts without spaces become their overlapping pairs of characters."""
    single = _unspaced(data)
    if not len(single):
        return starts, ends, firsts
    run = np.searchsorted(starts, single, side="right") - 1
    after = single + np.where(data[single] == 0xF0, 4, 3)
    cut = np.unique(np.concatenate([starts, single, after[after < ends[run]]]))
    run = np.searchsorted(starts, cut, side="right") - 1
    stops = np.minimum(np.append(cut[1:], len(data)), ends[run])
    of = np.isin(cut, single, assume_unique=True)
    pair = np.flatnonzero(of[:-1] & of[1:] & (run[:-1] == run[1:]))
    ends = stops.copy()
    ends[pair] = stops[pair + 1]
    return cut, ends, np.searchsorted(cut, offsets)


def _tokens(column: pa.Array) -> tuple[np.ndarray, ...]:
    offsets, data = raw(column)
    data = LOWER[data]
    starts, ends, firsts = spans(data, offsets, PUNCTUATION)
    starts, ends, firsts = _cut(data, offsets, starts, ends, firsts)
    return offsets, starts, ends, firsts, (SpanHash(data)(starts, ends) % np.uint64(BUCKETS)).astype(np.int64)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token buckets of each text, each once."""
    for piece in pieces(batches, "text"):
        _, _, _, firsts, buckets = _tokens(piece.column("text"))
        of = np.repeat(np.arange(piece.num_rows), np.diff(firsts))
        once = np.unique(of * BUCKETS + buckets)
        ends = np.searchsorted(once, np.arange(piece.num_rows + 1) * BUCKETS)
        once = (once % BUCKETS).astype(np.int32)
        bags = pa.array([once[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), bags], names=["doc_id", "bag"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    docs = np.zeros(2, np.int64)
    for piece in pieces(batches, "bag"):
        toxic = piece.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        offsets, data = raw(piece.column("bag"))
        buckets, of = data.view(np.int32), np.repeat(np.arange(piece.num_rows), np.diff(offsets) // 4)
        for side in (0, 1):
            counts[side] += np.bincount(buckets[toxic[of] == side], minlength=BUCKETS)
        docs += np.bincount(toxic, minlength=2)
    used = np.flatnonzero(counts.any(axis=0))
    yield blobs(used % _SLICES, _SLICES, at=used.astype(np.int32), clean=counts[0, used], toxic=counts[1, used])
    yield blobs(np.full(2, _SLICES), _SLICES + 1, at=np.array([-2, -1], np.int32), clean=docs[:1].repeat(2), toxic=docs[1:].repeat(2))


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    x = unpacked(batches, at=np.int32, clean=np.int64, toxic=np.int64)
    at, place = np.unique(x["at"], return_inverse=True)
    clean, toxic = (np.bincount(place, x[k], minlength=len(at)).astype(np.int64) for k in ("clean", "toxic"))
    yield blobs(np.zeros(len(at), np.int64), 1, at=at, clean=clean, toxic=toxic)


def segments(scores: list[float], gaps: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first, last, score) by place among the positive scores.

    ``scores`` are positive; ``gaps[i]`` is the (not positive) sum of what lies between the scores i and i + 1.
    """
    found: list[list] = []  # first, last, sum before it, sum up to its end
    total = 0.0
    for i, s in enumerate(scores):
        first, last, before = i, i, total
        total += s
        after = total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append([first, last, before, after, j])
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
        if i < len(gaps):
            total += gaps[i]
    return [(a, b, d - c) for a, b, c, d, _ in found]


@dataclass(frozen=True)
class Model:
    """Token scores by bucket, the constants of the extreme-value law, and the logistic function of log E."""

    scores: np.ndarray
    rate: float
    log_k: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    #: Whether toxic and other texts were learned from.
    fitted: bool = False

    def stats(self, text: str | Column = "text") -> Column:
        """Number of tokens, best score, and every segment (bytes from, to; score) of a text."""
        table = self.scores

        @F.arrow_udf(_STATS.replace(", ", ",").join(("struct<", ">")).replace(" ", ":"))
        def run(texts: pa.Array) -> pa.Array:
            return pa.concat_arrays([_stats(x.column("text"), table) for x in pieces(
                [pa.RecordBatch.from_arrays([texts], names=["text"])], "text")] or [_stats(texts, table)])

        return run(F.col(text) if isinstance(text, str) else text)

    def log_e(self, n_tokens: Column, best: Column) -> Column:
        return F.lit(self.log_k) + F.log(F.greatest(n_tokens, F.lit(1))) - F.lit(self.rate) * best

    def probability(self, n_tokens: Column, best: Column) -> Column:
        x = F.when(best > 0, F.least(self.log_e(n_tokens, best), F.lit(_TOP))).otherwise(F.lit(_TOP))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-self.shift) + F.lit(self.slope) * x))


#: log E of a text in which nothing scores, and the most that it counts; below -_TOP it makes no difference either.
_TOP = 30.0


def _stats(column: pa.Array, table: np.ndarray) -> pa.Array:
    offsets, starts, ends, firsts, buckets = _tokens(column)
    values = table[buckets]
    again = np.zeros(len(buckets), bool)
    again[1:] = buckets[1:] == buckets[:-1]
    again[firsts[:-1][np.diff(firsts) > 0]] = False  # a text's first token repeats none
    values[again & (values > 0)] = -FLOOR
    total = np.concatenate([[0.0], np.cumsum(values)])
    plus = np.flatnonzero(values > 0)
    bounds = np.searchsorted(plus, firsts)
    best, lists = np.zeros(len(column)), ([], [], [])
    for d in range(len(column)):
        own = plus[bounds[d] : bounds[d + 1]]
        found = segments(values[own].tolist(), (total[own[1:]] - total[own[:-1] + 1]).tolist()) if len(own) else []
        best[d] = max((s for _, _, s in found), default=0.0)
        lists[0].append([int(starts[own[a]] - offsets[d]) for a, _, _ in found])
        lists[1].append([int(ends[own[b]] - offsets[d]) for _, b, _ in found])
        lists[2].append([s for _, _, s in found])
    counts = pa.array([len(x) for x in lists[0]], pa.int64())
    arrays = [pa.array(np.diff(firsts), pa.int64()), pa.array(best), counts, pa.array(lists[0], pa.list_(pa.int32())),
              pa.array(lists[1], pa.list_(pa.int32())), pa.array(lists[2], pa.list_(pa.float64()))]
    return pa.StructArray.from_arrays(arrays, names=[x.split(" ")[0] for x in _STATS.split(", ")])


def _labelled(labels: DataFrame) -> DataFrame:
    """Rows that may be learned from; a document with several labels counts once, as toxic if any says so."""
    return (labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id")
            .agg(F.max("toxic").cast("long").alias("toxic")))


def token_scores(counts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, float]:
    """Scores by bucket from document frequencies (2, BUCKETS) and numbers of documents; lambda of the background."""
    y = counts + PRIOR
    rest = np.maximum(docs[:, None] - counts, 0) + PRIOR
    odds = np.log(y[1] / rest[1]) - np.log(y[0] / rest[0])
    deviation = np.sqrt(1 / y[1] + 1 / y[0])
    scores = np.where(odds - DEVIATIONS * deviation > 0, odds - DEVIATIONS * deviation, np.minimum(odds, 0)) - FLOOR
    scores = np.maximum(scores, -3.0)
    p = counts[0] / max(1, counts[0].sum())
    low, high = 1e-3, 50.0
    if (p * scores).sum() >= 0 or not (p[scores > 0] > 0).any():
        return scores, 1.0
    p, scores_seen = p[p > 0], scores[p > 0]
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if (p * np.exp(np.minimum(middle * scores_seen, 500))).sum() > 1 else (middle, high)
    return scores, low


def _logistic(x: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(1) = 1 / (1 + exp(slope x - shift)), by Newton steps with a light ridge."""
    beta = np.zeros(2)
    design = np.stack([-x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -30, 30)))
        gradient = design @ (ones - n * p) - np.array([1e-2, 1e-4]) * beta
        hessian = (design * (n * p * (1 - p) + 1e-9)) @ design.T + np.diag([1e-2, 1e-4])
        step = np.linalg.solve(hessian, gradient)
        beta += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows that are not held out. Without any, every text has the probability one half."""
    spark = docs.sparkSession
    known = stored(_labelled(labels))
    # Always a sort-merge join: only the texts' token numbers are exchanged, whatever the number of labels.
    kind = docs.schema["doc_id"].dataType.simpleString()
    bags = docs.where(~held_out()).select("doc_id", "text").mapInArrow(_bags, f"doc_id {kind}, bag binary")
    train = bags.join(known.hint("merge"), "doc_id").select("bag", "toxic")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "bucket int, at binary, clean binary, toxic binary"
    slices = train.mapInArrow(_count, schema).repartition(n, "bucket").mapInArrow(_total, schema).collect()
    counts, docs = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for r in slices:  # a number for each bucket and label at most
        at = np.frombuffer(r["at"], np.int32)
        for side, name in enumerate(("clean", "toxic")):
            found = np.frombuffer(r[name], np.int64)
            counts[side, at[at >= 0]] = found[at >= 0]
            if (at == -1).any():
                docs[side] = found[at == -1][0]
    scores, rate = token_scores(counts, docs)
    return Model(scores.astype(np.float32), rate)


def calibrated(model: Model, scored: DataFrame, labels: DataFrame) -> Model:
    """The model with K and the logistic function fitted to ``scored`` (doc_id, n_tokens, best) of all labelled rows."""
    rows = scored.join(_labelled(labels), "doc_id")
    raw_e = model.log_e(F.col("n_tokens"), F.col("best"))
    mean = rows.where("toxic = 0 AND best > 0").agg(F.avg(-raw_e)).first()[0]
    log_k = 0.0 if mean is None else float(mean) - float(np.euler_gamma)
    model = Model(model.scores, model.rate, log_k)
    x = F.when(F.col("best") > 0, F.greatest(F.least(model.log_e(F.col("n_tokens"), F.col("best")), F.lit(_TOP)), F.lit(-_TOP))).otherwise(_TOP)
    bins = rows.groupBy(F.round(x, 1).alias("x")).agg(F.sum("toxic").alias("ones"), F.count("*").alias("n")).collect()  # 601 at most
    if not bins:
        return Model(model.scores, model.rate, log_k, 0.0, 0.0)
    slope, shift = _logistic(*(np.array([float(r[k]) for r in bins]) for k in ("x", "ones", "n")))
    ones, n = sum(r["ones"] for r in bins), sum(r["n"] for r in bins)
    return Model(model.scores, model.rate, log_k, slope, shift, 0 < ones < n)


def scored_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` with the statistics of its text, row by row."""
    return docs.select("doc_id", model.stats().alias("s")).select("doc_id", "s.*")


def with_toxicity(docs: DataFrame, labels: DataFrame, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the probability under ``name``; texts stay in their task.

    It is null where there is nothing to learn from: no labelled text that may be used, or none of one label.
    """
    model = fit(docs, labels)
    model = calibrated(model, stored(scored_texts(docs, model).select("doc_id", "n_tokens", "best")), labels)
    stats = next(n for n in ("_stats" + "_" * k for k in range(len(docs.columns) + 2)) if n not in (*docs.columns, name))
    chance = model.probability(F.col(f"{stats}.n_tokens"), F.col(f"{stats}.best")) if model.fitted else F.lit(None).cast("double")
    return docs.withColumn(stats, model.stats()).withColumn(name, chance).drop(stats)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents", "doc_id", "text")
    labels = common.table(spark, folder, "labels", "doc_id", "toxic")
    model = fit(docs, labels)
    scored = stored(scored_texts(docs, model))
    model = calibrated(model, scored.select("doc_id", "n_tokens", "best"), labels)
    score = model.probability(F.col("n_tokens"), F.col("best"))
    significant = F.size(F.filter("scores", lambda s: model.log_e(F.col("n_tokens"), s) < float(np.log(SIGNIFICANT))))
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"),
                         (score >= 0.5).cast("int").alias("predicted"), significant.alias("n_passages"))


common.shipped(__name__)
