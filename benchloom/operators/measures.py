"""Scores out of what kernels measured: geometry, constraints, motion, consistency, fidelity.

Kernels leave one row of numbers a clip; everything after that is Column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.functions import axes as A

#: Sub-topology, then topology -> which measure is the geometry score.
BY_SUB = {"2d_planar": "spectral", "3d_spatial": "lattice", "aerodynamic": "surface", "rigid_housing": "lattice", "articulated": "articulated", "rotational": "rotary", "cable_hose": "kinematic"}
BY_TOPOLOGY = {"kinematic": "kinematic", "flexible": "kinematic", "lattice": "lattice", "surface": "lattice"}
#: Routes that yield nothing where a runner's faults are kept.
FAULTY = ("spectral", "rotary")

#: What a score means, for judges.
BANDS = "90-100: nothing physically impossible. 70-89: small approximations only. 50-69: one clear, local fault. 25-49: a known law is broken. 0-24: several grave faults. In doubt take the lower band, and look at the last frames for faults that add up."
PROMPT = "Rate from {low} to {high} how physically plausible the clip is: {content}\n{bands}\nAnswer with one whole number, then a reason."
CONSTRAINED = "Rate from {low} to {high} how physically plausible the clip is: {content}\nEach of these must hold throughout:\n{constraints}\n{bands}\nAnswer with one whole number, then a reason."


def lattice_score(points_a: Column, points_b: Column, matches: Column) -> Column:
    """Matched key points against the smaller set; fixed scores for too few points or matches."""
    least = F.least(points_a, points_b)
    return F.when(least < 10, 0.30).when(matches < 5, 0.10).when(matches < 20, 0.25).otherwise(F.greatest(F.lit(0.1), F.try_divide(matches.cast("double"), least)))


def surface_score(chamfer: Column, most: float = 1.0) -> Column:
    """1 for equal surfaces, at least 0.1; 0.1 too where a surface has no points."""
    return F.when(chamfer.isNull() | (chamfer == float("inf")), 0.1).otherwise(F.greatest(F.lit(0.1), 1.0 - chamfer / most))


def geometry_route(sub: Column, topology: Column, measures: dict[str, Column], strict_parity: bool = False) -> tuple[Column, Column]:
    """(method, score): the measure a topology calls for; 0 where it is unknown or not measured.

    ``strict_parity`` gives 0 on the routes that fail in a runner whose results must be matched.
    """
    pick = F.lit(None).cast("string")
    for table, name in ((BY_TOPOLOGY, topology), (BY_SUB, sub)):
        for key, method in table.items():
            pick = F.when(name == key, method).otherwise(pick)
    score = F.lit(0.0)
    for method, value in measures.items():
        if not (strict_parity and method in FAULTY):
            score = F.when(pick == method, F.coalesce(value, F.lit(0.0))).otherwise(score)
    return pick, score


def constraint_mean(rows: DataFrame) -> DataFrame:
    """One constraint score a clip: the mean of its checkers' scores, a failed checker counting 0."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(F.coalesce("score", F.lit(0.0)))))
    return rows.groupBy("video").agg(F.round(score, 4).alias("constraint"), F.count("*").alias("checkers"))


def viewpoint_motion(motion: Column, frames: Column, flow: Column, dark: Column, shifts: list[tuple[str, Column]], turns: list[tuple[str, Column]], height: Column) -> tuple[Column, Column]:
    """(method, degrees) of the camera's motion.

    A crane's rise comes from the first vertical shift that could be estimated, other motions
    from the first rotation; a still clip has 0, one that defies estimation null.
    """
    still = (frames < 2) | A.is_static(flow, dark)
    shift, turn = F.coalesce(*(c for _, c in shifts)), F.coalesce(*(c for _, c in turns))

    def which(options: list[tuple[str, Column]]) -> Column:
        out = F.lit("uncalculable")
        for name, c in reversed(options):
            out = F.when(c.isNotNull(), name).otherwise(out)
        return out

    crane = motion == "crane"
    method = F.when(still, "static_detected").when(crane, which(shifts)).otherwise(which(turns))
    return method, F.when(still, 0.0).when(crane, A.crane_angle(shift, height)).otherwise(F.abs(turn))


def temporal_consistency(ssim: Column, frames: Column, judged: Column) -> Column:
    """Mean likeness of neighbouring frames as 0..100, blended with a judge's; null below two frames."""
    return F.when(frames >= 2, F.round(A.temporal_blend(A.clamp(ssim * 100.0), judged), 2))


def visual_fidelity(ssim: Column, histogram: Column, frames: Column, judged: Column) -> Column:
    """Likeness to the reference image as 0..100; null without frames."""
    return F.when(frames >= 1, F.round(A.clamp(A.fidelity_blend(ssim * 100.0, histogram, judged)), 2))


def judge_prompt(content: Column, constraints: Column, low: int = 0, high: int = 100) -> Column:
    """The question put to a judge; it lists the constraints of a sample that has any."""
    fill = lambda t: F.replace(F.lit(t.replace("{low}", str(low)).replace("{high}", str(high)).replace("{bands}", BANDS)), F.lit("{content}"), content)
    bullets = F.array_join(F.transform(constraints, lambda c: F.concat(F.lit("- "), c)), "\n")
    return F.when(F.size(constraints) > 0, F.replace(fill(CONSTRAINED), F.lit("{constraints}"), bullets)).otherwise(fill(PROMPT))


def token_totals(calls: DataFrame) -> DataFrame:
    """Tokens of all calls of a judge; unknown counts are 0."""
    total = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return calls.groupBy("judge").agg(F.sum(total).alias("tokens"), F.count("*").alias("calls"))
