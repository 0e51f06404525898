"""Move labels: loss, class, risk, score, split, outcome — as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names and thresholds that downstream consumers rely on.
SAFE_RISKS = ("good", "playable")
UNSAFE_RISKS = ("mistake", "blunder")
RISK_ORDER = {"blunder": 0, "mistake": 1, "playable": 2, "good": 3}
BEST_CPL, GOOD_CPL, INACCURACY_CPL, MISTAKE_CPL = 20, 80, 150, 300
RISK_GOOD_CPL, RISK_PLAYABLE_CPL, RISK_MISTAKE_CPL = 50, 150, 300
NO_VALUE_KEY = -999_999
NO_RANK = 999_999
MISSING_SELECTION_SEVERITY = 1_000_000
BLUNDER_SEVERITY_BONUS = 1_000
GENERATOR_SOURCES = ("arena_candidate", "arena_candidate_pairwise", "policy_sample")
FINAL_SOURCES = ("arena_move", "arena_blunder")


def outcome(result: Column, color: Column) -> Column:
    """win / loss / draw / unfinished of one side; unknown results count as draws."""
    return (
        F.when(result == "*", "unfinished")
        .when(result.isin("1-0", "0-1"), F.when((result == "1-0") == (color == "white"), "win").otherwise("loss"))
        .otherwise("draw")
    )


def ply_color(ply: Column) -> Column:
    return F.when(F.pmod(ply, F.lit(2)) == 1, "white").otherwise("black")


def centipawn_loss(before: Column, after: Column, mate_before: Column, mate_after: Column) -> Column:
    """Loss against the position before the move; NULL when a mate score is involved."""
    known = mate_before.isNull() & mate_after.isNull() & before.isNotNull() & after.isNotNull()
    return F.when(known, F.greatest(before - after, F.lit(0)))


def mate_worsened(mate_before: Column, mate_after: Column) -> Column:
    """True when the move threw away a mate, or walked into or sped up an opposing one."""
    being_mated = F.coalesce(mate_after < 0, F.lit(False))
    return (
        F.when(mate_before.isNull() | (mate_before == 0), being_mated)
        .when(mate_before > 0, F.coalesce(mate_after <= 0, F.lit(True)))
        .otherwise(being_mated & (mate_after > mate_before))
    )


def move_class(cpl: Column, mate_before: Column, mate_after: Column) -> Column:
    return (
        F.when(
            mate_before.isNotNull() | mate_after.isNotNull(),
            F.when(mate_worsened(mate_before, mate_after), "mate_missed").otherwise("mate_position"),
        )
        .when(cpl.isNull(), "unknown")
        .when(cpl <= BEST_CPL, "best")
        .when(cpl <= GOOD_CPL, "good")
        .when(cpl <= INACCURACY_CPL, "inaccuracy")
        .when(cpl <= MISTAKE_CPL, "mistake")
        .otherwise("blunder")
    )


def risk(classification: Column, cpl: Column) -> Column:
    return (
        F.when(classification.isin("blunder", "mate_missed"), "blunder")
        .when(cpl.isNull(), "playable")
        .when(cpl <= RISK_GOOD_CPL, "good")
        .when(cpl <= RISK_PLAYABLE_CPL, "playable")
        .when(cpl <= RISK_MISTAKE_CPL, "mistake")
        .otherwise("blunder")
    )


def score(classification: Column, cpl: Column) -> Column:
    """0-100, half-even rounding; missed mates score 0 and unknown losses 50."""
    raw = F.bround(100 - cpl / 4, 0)
    return (
        F.when(classification == "mate_missed", 0)
        .when(cpl.isNull(), 50)
        .otherwise(F.greatest(F.least(raw, F.lit(100.0)), F.lit(0.0)))
        .cast("int")
    )


def reason_type(classification: Column, cpl: Column) -> Column:
    return (
        F.when((classification == "mate_missed") | F.coalesce(cpl > RISK_MISTAKE_CPL, F.lit(False)), "material_or_mate")
        .when(risk(classification, cpl) == "good", "none")
        .otherwise("unknown")
    )


def played_source(classification: Column) -> Column:
    return F.when(classification.isin("blunder", "mate_missed"), "arena_blunder").otherwise("arena_move")


def metadata_source(mode: Column) -> Column:
    return F.when(mode == "candidate_pairwise", "arena_candidate_pairwise").otherwise("arena_candidate")


def position_split(fen: Column) -> Column:
    """validation / test / train by the first byte of the position's sha256."""
    bucket = F.conv(F.substring(F.sha2(fen, 256), 1, 2), 16, 10).cast("int") % 10
    return F.when(bucket == 0, "validation").when(bucket == 1, "test").otherwise("train")


def vetoed(classification: Column, cpl: Column, threshold: Column | int) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (classification == "mate_missed") | F.coalesce(cpl > limit, F.lit(False))


def cpl_key(cpl: Column) -> Column:
    """Higher is better; unknown losses rank lowest."""
    return F.coalesce(-cpl, F.lit(NO_VALUE_KEY))


def generator_rank_key(rank: Column) -> Column:
    return F.coalesce(-rank, F.lit(NO_VALUE_KEY))


def risk_rank(label: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in RISK_ORDER.items() for x in pair])
    return mapping[label]


def is_safe(label: Column) -> Column:
    return label.isin(*SAFE_RISKS)


def is_unsafe(label: Column) -> Column:
    return label.isin(*UNSAFE_RISKS)


def pair_risk_label(left: Column, right: Column) -> Column:
    return F.array_join(F.array_sort(F.array(left, right)), "->")


def hard_case_categories(
    selected_risk: Column, target_risk: Column, selected_cpl: Column, target_cpl: Column, regret_threshold: int
) -> Column:
    """Why a selection is worth keeping; a selection outside the list is ``not_candidate``."""
    return F.when(
        selected_risk.isNull(), F.array(F.lit("not_candidate"))
    ).otherwise(
        F.array_compact(
            F.array(
                F.when(selected_risk == "blunder", "selected_blunder"),
                F.when(is_unsafe(selected_risk) & (target_risk == "good"), "missed_good"),
                F.when(selected_cpl - target_cpl >= regret_threshold, "high_regret"),
            )
        )
    )


def hard_case_severity(selected_risk: Column, selected_cpl: Column, target_cpl: Column) -> Column:
    bonus = F.when(selected_risk == "blunder", BLUNDER_SEVERITY_BONUS).otherwise(0)
    return (
        F.when(selected_risk.isNull(), MISSING_SELECTION_SEVERITY)
        .when(selected_cpl.isNull() | target_cpl.isNull(), 0)
        .otherwise(bonus + selected_cpl - target_cpl)
    )
