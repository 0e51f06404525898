"""Reuse of evaluations and the places where own code plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plywise.functions.text import evaluation_key
from plywise.operators.ordering import dense_index_by, last_per_key, with_one_row


def load_cache(lines: DataFrame, evaluation_schema: str) -> DataFrame:
    """Evaluation cache from JSON lines (``line_index``, ``value``): unreadable lines are ignored
    and the last line of a key wins."""
    schema = f"key STRING, evaluation {evaluation_schema}"
    parsed = lines.select("line_index", F.from_json("value", schema).alias("r")).select("line_index", "r.*")
    usable = parsed.where(F.col("key").isNotNull() & F.col("evaluation.classification").isNotNull())
    return last_per_key(usable, ["key"], ["line_index"]).drop("line_index")


def cache_lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a stored evaluation, and the distinct (fen, uci) still to be evaluated."""
    keyed = requests.withColumn("key", evaluation_key(F.col("fen"), F.col("uci")))
    hits = keyed.join(cache, "key")
    # A hot position is one row before the join.
    distinct = requests.select("fen", "uci").distinct().select(evaluation_key(F.col("fen"), F.col("uci")).alias("key"), "fen", "uci")
    misses = distinct.join(cache.select("key"), "key", "left_anti")
    return hits, misses


def cache_stats(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Hits and misses of a job that stores every new evaluation at once: a repeated new
    request misses once. Requests are read once: they become one row a move with their number, which is looked up."""
    asked = requests.groupBy("fen", "uci").agg(F.count(F.lit(1)).alias("n")).select(evaluation_key(F.col("fen"), F.col("uci")).alias("key"), "n")
    found = asked.join(cache.select("key").distinct().withColumn("known", F.lit(True)), "key", "left")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.count_if(F.col("known").isNull()).alias("cache_misses"))
    return total.withColumn("cache_hits", F.col("requests") - F.col("cache_misses"))


def grown_cache(requests: DataFrame, cache: DataFrame, evaluations: DataFrame) -> DataFrame:
    """New cache rows of a job: its misses with the evaluation of (fen, uci)."""
    _, misses = cache_lookup(requests, cache)
    return misses.join(evaluations, ["fen", "uci"]).select("key", "fen", "uci", "evaluation")


def evaluate_with(positions: DataFrame, make_evaluator: Callable[[], Callable[[str, str], Mapping]], schema: str,
                  tasks: int | None = None) -> DataFrame:
    """Evaluate (fen, uci) rows with own code. The evaluator is made once per task (an engine
    process, a model), rows arrive in Arrow batches. ``schema`` names the result fields;
    ``tasks`` spreads few but expensive rows over that many tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evaluator = make_evaluator()
        try:
            for batch in batches:
                results = [evaluator(f, u) for f, u in zip(batch["fen"], batch["uci"])]
                extra = pd.DataFrame(results, index=batch.index) if results else pd.DataFrame(index=batch.index)
                yield pd.concat([batch, extra], axis=1)
        finally:
            close = getattr(evaluator, "close", None)
            if close is not None:
                close()

    rows = positions.select("fen", "uci")
    spread = rows if tasks is None else rows.repartition(tasks, "fen", "uci")
    return spread.mapInPandas(run, f"fen STRING, uci STRING, {schema}")


def score_with(candidates: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """Attach a scorer's struct (centipawn_loss, classification, vetoed, ranking_score). The
    scorer maps the position and move columns to a column: an expression or a pandas UDF."""
    return candidates.withColumn("_score", scorer(F.col("fen"), F.col("uci"))).select("*", "_score.*").drop("_score")


def predict_with(rows: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a predictor over Arrow batches; it returns one prediction per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(predict, batches)

    return rows.mapInPandas(run, schema)


def ensure_dimension(new: DataFrame, existing: DataFrame, key: list[str], id_column: str) -> DataFrame:
    """Existing rows plus new natural keys with ids after the largest one.

    New keys are numbered by the order of their hash, in 65,536 blocks, so no single task
    sorts them all."""
    name = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in key]), 256)
    fresh = new.select(*key).distinct().join(existing.select(*key), key, "left_anti").withColumn("_h", name)
    blocked = fresh.withColumn("_b", F.substring("_h", 1, 4))
    numbered = dense_index_by(blocked, ["_b"], [F.col("_h")], "_n", start=1)
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    added = with_one_row(numbered, top).select((F.col("_top") + F.col("_n")).alias(id_column), *key)
    return existing.select(id_column, *key).unionByName(added)
