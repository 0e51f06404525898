"""Rates, means, intervals and weighted averages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.959963984540054


def wilson_low(successes: Column, total: Column) -> Column:
    return _wilson(successes, total)[0]


def wilson_high(successes: Column, total: Column) -> Column:
    return _wilson(successes, total)[1]


def _wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    """95 % score interval of a proportion; (0, 0) without observations."""
    n = F.when(total != 0, total.cast("double"))
    p = successes / n
    z2 = F.lit(Z_95 * Z_95)
    denominator = 1 + z2 / n
    center = (p + z2 / (2 * n)) / denominator
    margin = F.lit(Z_95) * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / denominator
    low = F.greatest(F.lit(0.0), center - margin)
    high = F.least(F.lit(1.0), center + margin)
    return (
        F.when(n.isNull(), F.lit(0.0)).otherwise(low),
        F.when(n.isNull(), F.lit(0.0)).otherwise(high),
    )


def rate(count: Column, total: Column) -> Column:
    """count / total, 0.0 when nothing was counted."""
    return F.when(total == 0, F.lit(0.0)).otherwise(count.cast("double") / F.when(total != 0, total))


def rate4(count: Column, total: Column) -> Column:
    return F.bround(rate(count, total), 4)


def mean_or_null(total: Column, count: Column) -> Column:
    """total / count, NULL when there is no value."""
    return total.cast("double") / F.when(count != 0, count)


def mean2(value: Column) -> Column:
    """Aggregate: mean of the known values rounded half-even to two digits."""
    return F.bround(F.avg(value), 2)


def weighted_avg(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean, 0.0 when the weights sum to zero."""
    total = F.sum(weight)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.sum(value * weight) / F.when(total != 0, total))


def weighted_avg_known(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean over rows with a value; NULL when no row has one."""
    known_weight = F.sum(F.when(value.isNotNull(), weight))
    return (
        F.when(F.count(value) == 0, F.lit(None).cast("double"))
        .when(known_weight == 0, F.lit(0.0))
        .otherwise(F.sum(value * weight) / F.when(known_weight != 0, known_weight))
    )


def count_if(condition: Column) -> Column:
    """Aggregate: how many rows satisfy the condition (NULL counts as no)."""
    return F.count(F.when(condition, F.lit(1)))


def score_percent(games: Column, wins: Column, draws: Column) -> Column:
    """Headline score: wins plus half the draws, in percent of games; NULL without games."""
    return (wins + draws * 0.5) / F.when(games != 0, games) * 100
