"""JSON-lines, text and store scans, and their sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise.functions.responses import _typed, evaluated_once
from plywise.functions.text import lenient_int, strip
from plywise.operators.ordering import dense_index_by
from plywise.schemas import ID_COLUMNS, table_schema


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One store table from Parquet, its id column named after the entity."""
    df = spark.read.schema(table_schema(name)).option("mergeSchema", "true").parquet(f"{root}/{name}")
    return _named(df, name)


def read_table_jdbc(spark: SparkSession, options: Mapping[str, str], name: str) -> DataFrame:
    """The same table from a database; give partitionColumn and bounds for a parallel read."""
    return _named(spark.read.format("jdbc").options(**options).option("dbtable", name).load(), name)


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.withColumnRenamed("id", ID_COLUMNS[name]) if name in ID_COLUMNS else df


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str, strict: bool = False) -> DataFrame:
    """One record per line with a given schema; blank lines are skipped.

    The strict variant fails the job on a line that is not a JSON object.
    """
    if not strict:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    value = F.when(F.startswith(strip(F.col("value")), F.lit("{")), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))
    )
    return lines.select(F.from_json(value, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def numbered_lines(spark: SparkSession, path: str | Sequence[str], name: str = "line_index") -> DataFrame:
    """Text lines with their position over all files (blank lines count)."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    return dense_index_by(lines, ["_file", "_start"], [F.col("_id")], name).select(name, "value")


def first_lines(lines: DataFrame, limit: int | None) -> DataFrame:
    """Raw line limit: the first ``limit`` lines, of which only the non-blank ones are kept."""
    kept = lines if limit is None else lines.where(F.col("line_index") < limit)
    return kept.where(strip(F.col("value")) != "")


def external_candidates(lines: DataFrame, text: str = "value") -> DataFrame:
    """Candidate moves from foreign JSON lines: aliases are tried in order, rows without
    a textual position or move are skipped.

    A line is parsed once and its fields are read once; aliases and filters use those columns.
    """
    kept = [c for c in lines.columns if c != text]
    record = F.col("_record")
    names = ("fen_before", "fen", "candidate_uci", "uci", "move", "source", "generator_idea")
    parsed = lines.select(*kept, F.try_parse_json(F.col(text)).alias("_record"))
    fields = evaluated_once(
        parsed,
        **{f"_{n}": _typed(record, f"$.{n}", "STRING") for n in names},
        _rank=F.try_variant_get(record, "$.candidate_rank_in_generator", "variant"),
    )
    first = lambda *aliases: F.coalesce(*[F.when(F.col(f"_{a}") != "", F.col(f"_{a}")) for a in aliases])
    # Numbers written as numbers or as digits count; booleans and decimals do not.
    rank = F.when(
        F.schema_of_variant("_rank").isin("BIGINT", "STRING"), lenient_int(F.try_variant_get("_rank", "$", "string"))
    )
    combined = fields.select(
        *kept, first("fen_before", "fen").alias("fen_before"), first("candidate_uci", "uci", "move").alias("candidate_uci"),
        F.coalesce(first("source"), F.lit("policy_sample")).alias("source"),
        rank.alias("candidate_rank_in_generator"), F.col("_generator_idea").alias("generator_idea"),
    )
    return combined.where(F.col("fen_before").isNotNull() & F.col("candidate_uci").isNotNull())


def read_prediction_files(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Prediction files in the given order, each row labelled with its file stem.

    Rows of a folder stand in the order of its files' names, blocks and rows (``line_ord``); Spark packs files into
    tasks by size, so the place of a task says nothing.
    """
    out: DataFrame | None = None
    for order, path in enumerate(paths):
        part = spark.read.schema(schema).json(path).select(
            "*",
            F.lit(PurePosixPath(path).stem).alias("gate_source"),
            F.lit(order).alias("file_ord"),
            F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("row")).alias("line_ord"),
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("at least one prediction file is required")
    return out


def require_fields(df: DataFrame, required: Sequence[str], integers: Sequence[str] = (), optional_integers: Sequence[str] = ()) -> DataFrame:
    """Reject column for raw records: the missing fields, or the first field that is no integer.

    ``df`` holds VARIANT column ``record``; rows with ``reject`` NULL are valid.
    """
    kind = lambda f: F.schema_of_variant(F.try_variant_get("record", f"$.{f}", "variant"))
    present = lambda f: F.try_variant_get("record", f"$.{f}", "variant").isNotNull()
    missing = F.array_compact(F.array(*[F.when(~present(f), f) for f in required]))
    is_int = lambda f: F.coalesce(kind(f) == "BIGINT", F.lit(False))
    is_null = lambda f: ~present(f) | F.coalesce(kind(f) == "VOID", F.lit(False))
    wrong = [F.when(~is_int(f), F.lit(f"has non-integer {f}")) for f in integers]
    wrong += [F.when(~is_int(f) & ~is_null(f), F.lit(f"has non-integer {f}")) for f in optional_integers]
    reject = F.when(
        F.size(missing) > 0, F.concat(F.lit("missing required fields: "), F.array_join(missing, ", "))
    ).otherwise(F.coalesce(*wrong) if wrong else F.lit(None).cast("string"))
    return df.withColumn("reject", reject)


def fail_on_reject(df: DataFrame, line: str = "line_number") -> DataFrame:
    """Turn rejected rows into a job failure that names the line."""
    message = F.concat(F.lit("line "), F.col(line).cast("string"), F.lit(" "), F.col("reject"))
    checked = F.when(F.col("reject").isNotNull(), F.raise_error(message)).otherwise(F.col(line))
    return df.withColumn(line, checked)


def write_jsonl(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "error") -> None:
    """Compact JSON lines with a fixed field order; NULL fields are written."""
    out = df.select(*columns) if columns else df
    out.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One output folder per split value."""
    df.write.partitionBy(split).option("ignoreNullFields", "false").json(path)


def sidecar(config: Mapping[str, object], stats: DataFrame, label: str = "stats") -> DataFrame:
    """One JSON document {config, stats|metrics} with sorted keys, as a one-row frame."""
    settings = F.struct(*[F.lit(config[k]).alias(k) for k in sorted(config)])
    numbers = F.struct(*sorted(stats.columns))
    body = F.struct(settings.alias("config"), numbers.alias(label))
    return stats.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def write_sidecar(config: Mapping[str, object], stats: DataFrame, path: str, label: str = "stats") -> None:
    sidecar(config, stats, label).coalesce(1).write.mode("overwrite").text(path)


def replace_summaries(summaries: DataFrame, path: str, only_given_runs: bool = False) -> None:
    """Replace the stored summaries: all of them, or only those of the runs that ``summaries`` holds."""
    writer = summaries.write.partitionBy("run_id").mode("overwrite")
    scope = "dynamic" if only_given_runs else "static"
    writer.option("partitionOverwriteMode", scope).parquet(path)
