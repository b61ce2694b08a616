"""Scores, levels, bands and decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.cleaning import OFFSET_TIME

# The rubric's axes with their largest value, levels with their largest total, and bands.
AXES = {"public_relevance": 2, "harm_urgency": 2, "vulnerability": 1}
LEVELS = ["low", "medium", "high"]
LOW_TOTAL, MEDIUM_TOTAL = 1, 3
BANDS = [(0.5, "<0.50"), (0.7, "0.50-0.70"), (0.9, "0.70-0.90")]
TOP_BAND = ">=0.90"
CONFIDENCES = ["low", "medium", "high"]
LONGEST_RATIONALE = 280


def score() -> Column:
    """Sum of the axes; null if any is null or out of range."""
    ok = [F.col(a).between(0, top) for a, top in AXES.items()]
    total = sum((F.col(a) for a in AXES), F.lit(0))
    return F.when(ok[0] & ok[1] & ok[2], total)


def level(total: Column) -> Column:
    return F.when(total <= LOW_TOTAL, "low").when(total <= MEDIUM_TOTAL, "medium").when(total.isNotNull(), "high")


def level_index(name: Column) -> Column:
    """0, 1, 2 of low, medium, high; null for anything else."""
    out = F.when(name == LEVELS[0], 0)
    for i, x in enumerate(LEVELS[1:], 1):
        out = out.when(name == x, i)
    return out


def validation_error(level_col: Column) -> Column:
    """The first rule an annotation breaks, or null if it keeps them all."""
    total = score()
    c = F.col
    return (
        F.when(F.coalesce(c("content_hash"), F.lit("")) == "", "missing_hash")
        .when(F.coalesce(c("blind_id"), F.lit("")) == "", "missing_blind_id")
        .when(total.isNull(), "axis_out_of_range")
        .when(~c("sensitivity_score").eqNullSafe(total), "score_mismatch")
        .when(~level_col.eqNullSafe(level(total)), "level_mismatch")
        .when(F.coalesce(F.length("sensitivity_rationale"), F.lit(0)) > LONGEST_RATIONALE, "rationale_too_long")
        .when(~F.coalesce(c("annotation_confidence").isin(CONFIDENCES), F.lit(False)), "unknown_confidence")
        .when(c("needs_review").isNull(), "needs_review_missing")
        .when(~F.coalesce(c("annotation_round") >= 1, F.lit(False)), "round_not_positive")
        .when(~F.coalesce(c("annotated_at").rlike(OFFSET_TIME), F.lit(False)), "time_without_offset")
    )


def confidence_band(p: Column) -> Column:
    out = F.when(p.isNull() | F.isnan(p), None)
    for top, name in BANDS:
        out = out.when(p < top, name)
    return out.otherwise(TOP_BAND)


def argmax_first(names: list[str], values: list[Column]) -> Column:
    """The name of the largest value, the first of several; null if any value is null."""
    arr = F.array(*values)
    known = ~F.exists(arr, lambda v: v.isNull())
    at = F.array_position(arr, F.array_max(arr)).cast("int")
    return F.when(known, F.element_at(F.array(*[F.lit(n) for n in names]), at))


def probabilities_consistent(values: list[Column], confidence: Column) -> Column:
    """Whether the values sum to 1 and the confidence is their largest, both within 1e-5."""
    return _close(sum(values, F.lit(0.0)), F.lit(1.0)) & _close(confidence, F.greatest(*values))


def _close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-5) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def priority(predicted: Column, p: list[Column], confidence: Column, f1: Column) -> Column:
    """P25: active-learning priority: ``2`` where high is predicted, ``+ (1 - confidence) + (1 - margin) + (1 - f1) / 4``,
    where the margin is that of the two largest probabilities and an unknown ``f1`` counts as 1."""
    down = F.sort_array(F.array(*p), asc=False)
    margin = F.get(down, 0) - F.get(down, 1)
    high = F.when(F.coalesce(predicted == LEVELS[-1], F.lit(False)), 2.0).otherwise(0.0)
    return high + (1 - confidence) + (1 - margin) + 0.25 * (1 - F.coalesce(f1, F.lit(1.0)))


def ordinal_decode(p1: Column, p2: Column, t1: float, t2: float) -> Column:
    """Level from P(at least medium) and P(high), the second held at or below the first."""
    capped = F.least(p1, p2)
    return F.when(p1.isNull() | p2.isNull(), None).when(p1 < t1, "low").when(capped < t2, "medium").otherwise("high")


def prudence(weights: tuple[float, float, float]) -> Column:
    w = weights
    return w[0] * F.col("p_low") + w[1] * F.col("p_medium") + w[2] * F.col("p_high")


def fused_fake(p_fake: Column, rho: Column, epsilon: Column | float) -> Column:
    """Fake if and only if ``p_fake >= 0.5 - epsilon x rho``; the tie is fake."""
    return p_fake >= 0.5 - epsilon * rho


def half_even(x: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.bround(x).cast("long")


def signed_error(predicted: Column, truth: Column) -> tuple[Column, Column]:
    """Distance of two levels in ranks, signed and absolute; null unless both are levels."""
    e = level_index(predicted) - level_index(truth)
    return e, F.abs(e)


def planned_risk(domain_risk: Column, harm: Column, realism: Column) -> Column:
    """Half the domain's risk, three tenths of the harm and two of the realism."""
    return 0.5 * domain_risk + 0.3 * harm + 0.2 * realism


def needs_review_default(confidence: Column) -> Column:
    """What ``needs_review`` is before anyone decides: true for low confidence."""
    return F.coalesce(confidence == "low", F.lit(False))
