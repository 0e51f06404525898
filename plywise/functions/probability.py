"""Label probabilities from stored log-probabilities."""

from __future__ import annotations

import math
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The score of each risk label, in label order.
RISK_SCORE = {"blunder": 0.0, "mistake": 1.0, "playable": 2.0, "good": 3.0}


@F.arrow_udf(DoubleType())
def exp(x: pa.Array) -> pa.Array:
    """e to the x by the C library, for x up to 0. ``F.exp`` is off by one in the last place at some x, which decides between
    rows whose scores are alike but for rounding."""
    return pa.array([None if v is None else math.exp(v) for v in x.to_pylist()], pa.float64())


def softmax(logprobs: dict[str, Column]) -> dict[str, Column]:
    top = F.greatest(*logprobs.values())
    weights = {label: exp(value - top) for label, value in logprobs.items()}
    total = sum(weights.values(), F.lit(0.0))
    return {label: weight / total for label, weight in weights.items()}


def predicted_label(logprobs: dict[str, Column]) -> Column:
    """Arg-max; the first label of the order wins ties."""
    top = F.greatest(*logprobs.values())
    return F.coalesce(*[F.when(value == top, label) for label, value in logprobs.items()])


def expected_risk_score(probabilities: dict[str, Column]) -> Column:
    return sum((p * RISK_SCORE[label] for label, p in probabilities.items()), F.lit(0.0))


# Helpers travel with the functions that use them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
