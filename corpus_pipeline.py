"""From documents to packed training sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise.llm import common, mixing, packing, simhash, suffixes, toxicity
from plywise.session import released


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely toxic than not.

    Where no labelled document can be learned from, or none of them is toxic, nothing is known to be toxic and all stay.
    Null and empty texts are scored like others, copies alike. Columns of any name are kept.
    """
    labels = common.table(spark, sf_dir, "labels", "doc_id", "toxic")
    score = next(n for n in ("toxicity" + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    return toxicity.with_toxicity(docs, labels, score).where(F.coalesce(F.col(score) < 0.5, F.lit(True))).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (words by five, similarity 0.8): the one with the least doc_id.

    A row without an id stays only where no other of its group has one; of several rows with the same least id, or of
    copies row by row, one stays. Texts without a word are copies of each other. Columns of any name and kind are kept.
    Where ids name the rows, as they usually do, the documents themselves are read again; else a copy of them with numbers.
    """
    facts = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if facts["n"] == facts["ids"]:
        found = simhash.similar(docs, shingle=5, percent=80)
        least = found.groupBy("component").agg(F.min("doc_id").alias("doc_id"))
        return docs.join(least.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    row = next(n for n in ("_row" + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = common.stored(docs.withColumn(row, F.monotonically_increasing_id()))
    found = simhash.similar(rows.select(F.col(row).alias("doc_id"), "text"), shingle=5, percent=80).withColumnRenamed("doc_id", row)
    ids = found.join(rows.select(row, "doc_id"), row)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    kept = ids.groupBy("component").agg(F.min(order)[row].alias(row))
    return rows.join(kept.select(row), row, "left_semi").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of 100 bytes that stands earlier, and drops documents of which no word is left."""
    found = suffixes.deduplicated(docs, docs.columns, "text")
    cut = found.withColumn("text", F.col("kept").cast("string")).where(mixing.words_of("text") > 0)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: the words taken over the document's words, rounded by chance.

    The chance is a hash of the row, so reruns agree, and a source's words come near its target. Rows alike in doc_id,
    text and source share what is taken of them. The mix itself sees ids, hashes and sizes; texts are joined to it once.
    """
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    found = mixing.mixed(hashed, ["doc_id", "_hash", "source"])
    rates = (found.groupBy("doc_id", "_hash", "source").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("_rate"))
             .select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_key"), F.col("source").alias("_source"), "_rate"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")) & F.col("source").eqNullSafe(F.col("_source"))
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("times")), F.lit(1 << 20)) / (1 << 20)
    joined = hashed.join(rates.hint("merge"), same).withColumn("_times", F.floor(F.col("_rate") + chance).cast("int"))
    return joined.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixing", mixed),
    ("packing", sequences),
]
#: Its models, hashes and tokens are not SQL's; the stages are tested against brute force.
ORACLE_SQL = None


@released
def prepared(docs: DataFrame, spark: SparkSession, sf_dir: str, stages: int) -> DataFrame:
    """``docs`` after so many stages. What a stage stored is dropped once it is done, and its result once the next one is."""
    before = prepared(docs, spark, sf_dir, stages - 1) if stages > 1 else docs
    return STAGES[stages - 1][1](spark, before, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return STAGES[-1][1](spark, prepared(docs, spark, sf_dir, len(STAGES) - 1), sf_dir)
