"""Session construction and the shared working folder of a job."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from contextvars import ContextVar
from functools import cache, wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"
#: Off, a join takes its sides where they lie by some of its keys, as a grouping does, instead of exchanging both by all.
JOIN_IN_PLACE = "spark.sql.requireAllClusterKeysForCoPartition"
#: Paths of the tables that the innermost ``released`` job has stored so far.
_TABLES: ContextVar[list[str] | None] = ContextVar("_TABLES", default=None)


def build_session(
    app: str, master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str | None = None
) -> SparkSession:
    """A session with adaptive execution and UTC time; the cluster decides the rest.

    ``master``, ``shuffle_partitions`` and ``driver_memory`` are for local runs only.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(JOIN_IN_PLACE, "false")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory is not None:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a folder of its own; a cluster has no folder that all see, so
    there it is an error.
    """
    root = spark.conf.get(SHARED_DIR_KEY, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {SHARED_DIR_KEY} to a folder that all executors share")
        root = _own_dir()
    return root.rstrip("/")


@cache
def _own_dir() -> str:
    return "file:" + tempfile.mkdtemp(prefix="plywise-")


def stored(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and read again after the loss of an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid4().hex}"
    if (made := _TABLES.get()) is not None:
        made.append(path)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(job: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``job``, of a DataFrame and more, with its result stored; the tables that it stored on the way are dropped then.

    They also go after an error. The result of a job inside another one is a table on the way of that one.
    """

    @wraps(job)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        return _run(job, df, *args, **kwargs)

    return run


def _run(job: Callable[..., DataFrame], df: DataFrame, *args, **kwargs) -> DataFrame:
    made: list[str] = []
    outer = _TABLES.set(made)
    try:
        found = stored(job(df, *args, **kwargs), "plywise")
        result = made.pop()
    finally:
        _TABLES.reset(outer)
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
        for path in made:
            folder = hadoop.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    if (tables := _TABLES.get()) is not None:
        tables.append(result)
    return found
