"""Rewards of a proposed move, linear or tactical."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reward scale.
MALFORMED_REWARD = -1.0
ILLEGAL_REWARD = {"linear": -0.5, "tactical": -1.0}
LINEAR_CAP = 300
FULL_REWARD_CPL = 20
TACTICAL_LEVELS = (1.0, 0.6, 0.1, -0.8)
TACTICAL_FLOOR = -1.0


@dataclass(frozen=True)
class RewardRule:
    mode: str = "linear"
    cpl_cap: int = LINEAR_CAP
    good_cpl: int = 80
    inaccuracy_cpl: int = 150
    blunder_cpl: int = 300

    def __post_init__(self) -> None:
        if self.mode not in ILLEGAL_REWARD:
            raise ValueError("mode must be 'linear' or 'tactical'")


def linear_reward(cpl: Column, cap: int = LINEAR_CAP) -> Column:
    return 1.0 - F.least(cpl, F.lit(cap)) / F.lit(float(cap))


def tactical_reward(cpl: Column, rule: RewardRule = RewardRule("tactical")) -> Column:
    """Piecewise-linear in the loss, between the knots of the rule."""
    knots = (FULL_REWARD_CPL, rule.good_cpl, rule.inaccuracy_cpl, rule.blunder_cpl)
    out = F.when(cpl <= knots[0], TACTICAL_LEVELS[0])
    for i in range(1, len(knots)):
        x0, x1, y0, y1 = knots[i - 1], knots[i], TACTICAL_LEVELS[i - 1], TACTICAL_LEVELS[i]
        value = F.lit(y1) if x1 <= x0 else F.lit(y0) + (cpl - x0) / F.lit(float(x1 - x0)) * F.lit(y1 - y0)
        out = out.when(cpl <= x1, value)
    return out.otherwise(TACTICAL_FLOOR)


def move_reward(
    parse_ok: Column,
    legal_ok: Column,
    cpl: Column,
    classification: Column,
    move: Column,
    best_move: Column,
    rule: RewardRule = RewardRule(),
) -> Column:
    without_loss = F.when(F.coalesce(move == best_move, F.lit(False)), 1.0)
    if rule.mode == "tactical":
        without_loss = without_loss.when(classification == "mate_missed", -1.0)
    with_loss = tactical_reward(cpl, rule) if rule.mode == "tactical" else linear_reward(cpl, rule.cpl_cap)
    return (
        F.when(~parse_ok, MALFORMED_REWARD)
        .when(~legal_ok, ILLEGAL_REWARD[rule.mode])
        .when(cpl.isNull(), without_loss.otherwise(0.0))
        .otherwise(with_loss)
    )
