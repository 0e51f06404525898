"""Incremental views over landed game files (Structured Streaming, file source)."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from plywise.functions.text import evaluation_key
from plywise.operators import summaries
from plywise.operators.ordering import last_per_key
from plywise.operators.selection import first_rows
from plywise.session import stored
from plywise.sources.records import replace_summaries
from plywise.sources.versions import Versioned, latest

#: Folders that a table's keys are dealt into.
BUCKETS = 64
#: Hashes of keys that are sent to every task, at most.
FEW = 1_000_000


def stream_files(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    """Stream of Parquet files landing in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def _started(writer: DataStreamWriter, checkpoint: str, trigger: Mapping | None) -> StreamingQuery:
    """Without a trigger the query takes what has landed and ends; with one (as ``{"processingTime": "10 seconds"}``)
    it goes on, and the caller stops it."""
    query = writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    if trigger is None:
        query.awaitTermination()
    return query


def _run(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: Mapping | None) -> StreamingQuery:
    return _started(stream.writeStream.foreachBatch(on_batch), checkpoint, trigger)


def capture(stream: DataFrame, target: str, checkpoint: str, trigger: Mapping | None = None) -> StreamingQuery:
    """Append every landed row once (exactly-once by the checkpointed file sink)."""
    return _started(stream.writeStream.format("parquet").option("path", target).outputMode("append"), checkpoint, trigger)


def latest_state(versions: DataFrame, key: str, version: str) -> DataFrame:
    """Current row of every key among captured versions."""
    return last_per_key(versions, [key], [version])


def _numbered(batch: DataFrame, target: str, checkpoint: str, partition_by: tuple = (), notes: dict | None = None) -> Versioned:
    """The table that this checkpoint's batches are written to; another checkpoint's batches are refused."""
    identity = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
    return Versioned(batch.sparkSession, target, partition_by, identity, notes)


def latest_games(stream: DataFrame, target: str, checkpoint: str, limit: int, trigger: Mapping | None = None) -> StreamingQuery:
    """Keep the newest games. The state store holds the current row of every game, the most recent update; a batch adds the
    rows of the games that it changes, and merged parts keep the newest games only. ``stream(game_id, started_at, ...)``.
    """
    version = "ended_at" if "ended_at" in stream.columns else "started_at"
    others = [c for c in stream.columns if c != "game_id"]
    current = stream.groupBy("game_id").agg(F.max_by(F.struct(*others), F.struct(version)).alias("row")).select("game_id", "row.*")

    def newest(rows: DataFrame) -> DataFrame:
        return first_rows(latest(rows, ["game_id"]), ["started_at", "game_id"], limit, descending=True)

    def write(batch: DataFrame, batch_id: int) -> None:
        _numbered(batch, target, checkpoint, notes={"keys": ["game_id"], "newest": limit}).append(batch, batch_id, newest)

    return _started(current.writeStream.outputMode("update").foreachBatch(write), checkpoint, trigger)


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """The view as of the last finished batch."""
    table = Versioned(spark, target)
    rows, notes = table.rows(), table.noted()
    if rows is None:
        raise ValueError(f"no batch was written to {target}")
    if "keys" not in notes:
        return rows.drop("part")
    return first_rows(latest(rows, notes["keys"]), ["started_at", "game_id"], notes["newest"], descending=True)


def match_progress(stream: DataFrame, target: str, checkpoint: str, trigger: Mapping | None = None) -> StreamingQuery:
    """Finished and started games per run. The state store remembers which games have started and finished, so an update
    counts nothing twice, and a game that has finished stays finished; a batch adds the counts of the runs that it
    changes. ``stream(game_id, run_id, result)``.
    """
    reached = F.array_compact(F.array(F.lit("started"), F.when(F.col("result") != "*", "completed")))
    once = stream.select("game_id", "run_id", F.explode(reached).alias("reached")).dropDuplicates(["game_id", "reached"])
    count = lambda what: F.count_if(F.col("reached") == what).alias(f"games_{what}")

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("run_id").agg(count("started"), count("completed"))
        _numbered(batch, target, checkpoint).append(counts, batch_id, progress_counts)

    return _started(once.writeStream.outputMode("append").foreachBatch(write), checkpoint, trigger)


def progress_counts(changes: DataFrame) -> DataFrame:
    """Started and finished games of every run, from the counts of the batches."""
    return changes.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("games_started", "games_completed")])


def progress_status(progress: DataFrame, requested: DataFrame) -> DataFrame:
    """Progress against the requested number of games: running or completed."""
    done = F.coalesce("games_completed", F.lit(0))
    return requested.join(progress, "run_id", "left").select(
        "run_id", "games_requested", F.coalesce("games_started", F.lit(0)).alias("games_started"),
        done.alias("games_completed"),
        F.when(done >= F.col("games_requested"), "completed").otherwise("running").alias("status"),
    )


def rebuild_summaries(stream: DataFrame, summarize: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, trigger: Mapping | None = None) -> StreamingQuery:
    """After each batch of games, recompute the runs it touched and replace their partitions.

    ``summarize`` takes the affected run ids (column ``run_id``) and returns summary rows; the
    overwrite is idempotent, so a repeated batch changes nothing.
    """

    def rebuild(batch: DataFrame, batch_id: int) -> None:
        affected = batch.select("run_id").where(F.col("run_id").isNotNull()).distinct()
        replace_summaries(summarize(affected), target, only_given_runs=True)

    return _run(stream, rebuild, checkpoint, trigger)


def grow_summaries(
    stream: DataFrame, measure: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, trigger: Mapping | None = None
) -> StreamingQuery:
    """Keep the totals of participants and colours by what each batch of games changes.

    ``measure`` takes the batch's games, the latest row of each, and returns their sides (``side_measures``); nothing else
    reads facts. A game's sides are stored; where it comes again, the old ones are taken out and the new ones added, and
    only these changes are written to the totals, which add up. A repeated batch changes nothing.
    """

    def grow(batch: DataFrame, batch_id: int) -> None:
        games = last_per_key(batch, ["game_id"], [c for c in ("ended_at", "started_at") if c in batch.columns] or ["run_id"])
        games = stored(games, "games")
        sides = F.collect_list(F.struct("participant_id", "color", "run_id", *summaries.MEASURES)).alias("sides")
        measured = measure(games).groupBy("game_id").agg(sides)
        new = stored(games.select("game_id").join(measured, "game_id", "left").withColumn("bucket", _bucket("game_id")), "sides")
        known = _numbered(batch, f"{target}/games", checkpoint, ("bucket",))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        before = known.rows(batch_id - 1, F.col("bucket").isin(touched)) if batch_id > 0 else None
        changes = _unpacked(new, 1)
        if before is not None:
            old = latest(before.join(new.select("game_id"), "game_id", "left_semi"), ["game_id"])
            changes = changes.unionByName(_unpacked(old, -1))
        totals = _numbered(batch, f"{target}/totals", checkpoint)
        totals.append(summaries.total_measures(changes), batch_id, summaries.merged_totals)
        known.append(new, batch_id, lambda rows: latest(rows, ["game_id"]))

    return _run(stream, grow, checkpoint, trigger)


def read_summary_totals(spark: SparkSession, target: str) -> DataFrame:
    """Totals by participant and colour as of the last finished batch."""
    return summaries.merged_totals(Versioned(spark, f"{target}/totals").rows())


def _unpacked(games: DataFrame, sign: int) -> DataFrame:
    sides = games.select("game_id", F.inline("sides"))
    if sign > 0:
        return sides
    return sides.select("game_id", "participant_id", "color", F.lit(None).cast("long").alias("run_id"), *[(-F.col(m)).cast(games.schema["sides"].dataType.elementType[m].dataType).alias(m) for m in summaries.MEASURES])


def _bucket(column: Column | str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def grow_cache(requests: DataFrame, seed: DataFrame, evaluations: DataFrame, target: str, checkpoint: str, trigger: Mapping | None = None) -> StreamingQuery:
    """Add the evaluations of new requests to the cache, batch by batch.

    Seed and cache are dealt into buckets by key; a batch opens the buckets of its keys only, and writes what it adds. Keys are
    as long as their hash, so they are made of position and move where they are compared, and not written or exchanged.
    """

    def grow(batch: DataFrame, batch_id: int) -> None:
        key = evaluation_key(F.col("fen"), F.col("uci"))
        asked = stored(batch.select("fen", "uci").distinct().withColumn("bucket", _bucket(key)), "requests")
        touched = F.col("bucket").isin([r["bucket"] for r in asked.select("bucket").distinct().collect()])
        first = _numbered(batch, f"{target}/seed", checkpoint, ("bucket",))
        first.append(seed.withColumn("bucket", _bucket("key")), 0)
        table = _numbered(batch, f"{target}/grown", checkpoint, ("bucket",))
        known = first.rows(where=touched).select(F.col("key").alias("known"))
        earlier = table.rows(batch_id - 1, touched) if batch_id > 0 else None
        if earlier is not None:
            known = known.unionByName(earlier.select(F.col("key").alias("known")))
        misses = asked.join(known, key == F.col("known"), "left_anti").join(evaluations, ["fen", "uci"])
        misses = misses.withColumn("key", key).select(*seed.columns, "bucket")
        table.append(misses, batch_id, lambda rows: latest(rows, ["key"]))

    return _run(requests, grow, checkpoint, trigger)


def read_grown(spark: SparkSession, target: str) -> DataFrame:
    """What the batches have added to the seed; of a key that was written twice, the last one.

    Hashes of keys are counted first, so rows whose key was written once are read as they are.
    """
    rows, hashed = Versioned(spark, f"{target}/grown").rows().drop("bucket"), F.xxhash64("key")
    twice = stored(rows.groupBy(hashed.alias("_hash")).count().where("count > 1").select("_hash"), "twice")
    n = twice.count()
    if n == 0:
        return rows.drop("part")
    if n > FEW:
        return latest(rows, ["key"])
    few = lambda how: rows.withColumn("_hash", hashed).join(F.broadcast(twice), "_hash", how).drop("_hash")
    return few("left_anti").drop("part").unionByName(latest(few("left_semi"), ["key"]))
