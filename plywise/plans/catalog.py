"""All registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plywise.plans import (  # noqa: F401
    board_queries,
    candidate_queries,
    dataset_queries,
    game_queries,
    order_queries,
    prediction_queries,
    stream_queries,
)
from plywise.plans.registry import REGISTRY, runner


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(name) for name in REGISTRY}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}
