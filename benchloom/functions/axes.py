"""Scores and gates as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchloom import registry as R


def sanitize(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def measured(x: Column) -> Column:
    """``sanitize``, and -1 (the tables' mark for "not measured") as null."""
    return F.when(x != -1.0, sanitize(x))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def canonical_axis(name: Column) -> Column:
    return R.mapped(R.AXIS_ALIASES, name)


def tidy(name: Column) -> Column:
    """A category name in its usual spelling: lower case, underscores."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_"), F.lit(""))


def canonical_domain(name: Column) -> Column:
    return R.mapped(R.LEGACY_DOMAINS, tidy(name))


def canonical_task(name: Column) -> Column:
    return R.mapped(R.LEGACY_TASKS, tidy(name))


def floored(axis: str, score: Column) -> Column:
    """At least the floor of the axis; NaN counts as the floor, an absent score stays absent."""
    floor = F.lit(R.FLOORS.get(axis, R.UNKNOWN_FLOOR))
    return F.when(score.isNotNull(), F.greatest(floor, F.nanvl(score, floor)))


def floor_of(axis: Column) -> Column:
    return F.coalesce(F.try_element_at(R.literal_map(R.FLOORS), axis), F.lit(R.UNKNOWN_FLOOR))


def fold_motion(reference: Column, motion: Column) -> Column:
    """The reference axis with motion folded in; motion alone stands for it where it is absent."""
    m = clamp(motion)
    return F.when(m.isNull(), reference).when(reference.isNull(), m).otherwise(0.7 * reference + 0.3 * m)


def normalise_constraint(score: Column) -> Column:
    """0..1 and 0..100 scales as 0..100."""
    return clamp(F.when(score <= 1.0, score * 100.0).otherwise(score))


def fold_constraint(geometry: Column, constraint: Column) -> Column:
    c = normalise_constraint(constraint)
    return F.when(geometry.isNotNull() & c.isNotNull(), 0.7 * geometry + 0.3 * c).otherwise(geometry)


def rif(*axes: Column) -> Column:
    """Geometric mean of the rotation-sensitive axes that are present; null for fewer than two."""
    n = reduce(lambda a, b: a + b, (F.when(a.isNotNull(), 1).otherwise(0) for a in axes))
    product = reduce(lambda a, b: a * b, (F.when(a.isNull(), F.lit(1.0)).otherwise(F.greatest(a, F.lit(0.0))) for a in axes))
    return F.when(n >= 2, F.pow(product, F.lit(1.0) / n))


def rif_gate(value: Column, motion: Column) -> Column:
    """Null for a static clip; an unknown motion does not gate."""
    return F.when(motion < R.STATIC, F.lit(None)).otherwise(value)


def gate_multiplier(*motion_scores: Column) -> Column:
    """Share of the score that motion fidelity leaves; 1 where motion is unknown."""
    return clamp(F.coalesce(*motion_scores, F.lit(100.0)) / 100.0, 0.0, 1.0)


def strict_pass(*axes: Column) -> Column:
    """Whether every axis that is present reaches the threshold; false where none is."""
    any_ = reduce(lambda a, b: a | b, (a.isNotNull() for a in axes))
    return any_ & reduce(lambda a, b: a & b, (F.coalesce(a >= R.STRICT, F.lit(True)) for a in axes))


def motion_tier(motion: Column) -> Column:
    out = F.when(motion.isNull(), F.lit(None))
    for below, name in R.TIERS:
        out = out.when(motion < below, name)
    return out.otherwise("full")


def parse_target(target: Column) -> Column:
    """Degrees of a number or of orbit_cw_, orbit_ccw_ and crane_up_ names; else null."""
    t = F.trim(target)
    named = t.rlike(r"^(orbit_cw|orbit_ccw|crane_up)_.*deg$")
    return F.when(named, F.regexp_replace(F.substring_index(t, "_", -1), "deg", "").try_cast("double")).otherwise(t.try_cast("double"))


def motion_fidelity(actual: Column, target: Column) -> Column:
    """100 at the target, falling to 0 at 45 degrees from it."""
    return F.when(actual.isNotNull() & target.isNotNull(), F.round(100.0 * F.greatest(F.lit(0.0), 1.0 - F.abs(actual - target) / 45.0), 4))


def crane_angle(dy: Column, height: Column) -> Column:
    return F.degrees(F.atan2(F.abs(dy), (height / 2.0) / max(math.tan(math.radians(30)), 1e-6)))


def is_static(flow: Column, dark: Column) -> Column:
    return flow < F.when(dark, 0.5).otherwise(0.8)


def kinematic_blend(kinematic: Column, symmetry: Column) -> Column:
    return 0.6 * kinematic + 0.4 * symmetry


def temporal_blend(cv: Column, judged: Column) -> Column:
    return F.when(judged.isNotNull(), 0.4 * cv + 0.6 * judged).otherwise(cv)


def fidelity_blend(ssim: Column, histogram: Column, judged: Column) -> Column:
    """SSIM and histogram correlation (-1..1) as 0..100, half of it a judge's where there is one."""
    cv = 0.6 * ssim + 0.4 * ((histogram + 1.0) / 2.0 * 100.0)
    return F.when(judged.isNotNull(), 0.5 * cv + 0.5 * judged).otherwise(cv)


def violation_label(violation: Column) -> Column:
    return F.substring_index(violation, ":", 1)


def worst_bucket(profile: Column) -> Column:
    """The hardest level in a difficulty profile; medium where it has none."""
    values = F.transform(F.map_values(profile), lambda v: F.lower(F.trim(v)))
    out = F.when(F.array_contains(values, "adversarial"), "adversarial")
    for level in ("hard", "medium", "easy"):
        out = out.when(F.array_contains(values, level), level)
    return out.otherwise("medium")


def axis_bucket(profile: Column, axis: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.try_element_at(profile, F.lit(axis)))), F.lit("medium"))


def image_target_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Longest side at most 1600 and at most 2.25 megapixels."""
    side = F.least(F.lit(1.0), 1600.0 / F.greatest(width, height))
    scale = F.when(width * height * side * side > 2_250_000.0, F.sqrt(2_250_000.0 / (width * height))).otherwise(side)
    size = lambda x: F.greatest(F.lit(1).cast("bigint"), F.floor(x * scale))
    return size(width), size(height)


def curation_status(width: Column, height: Column) -> Column:
    return F.when(F.least(width, height) < 700, "removed_too_small").otherwise("kept")


def one_decimal(x: Column) -> Column:
    return F.coalesce(F.format_string("%.1f", F.round(x, 1)), F.lit("-"))
