"""Registration of named queries together with their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plywise.plans.fixtures import Fixtures
from plywise.session import JOIN_IN_PLACE, stored


@dataclass(frozen=True)
class Query:
    build: Callable[[Fixtures], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function from fixtures to a DataFrame under a name."""

    def wrap(build: Callable[[Fixtures], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(build, sql)
        return build

    return wrap


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set(JOIN_IN_PLACE, "false")
        return REGISTRY[name].build(Fixtures(spark, folder))

    return run


def written(fx: Fixtures, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for queries that read it several times."""
    return stored(df, name, "zstd")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that the order of additions does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
