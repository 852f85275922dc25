"""From measured axes to one scored row a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom import registry as R
from benchloom.functions import axes as A
from benchloom.operators.dataops import latest
from benchloom.operators.taxonomy import infer_task_category

SHORT = ("logic", "geometry", "physics", "temporal", "reference")
#: Columns of sample results that hold the axes in the order of ``SHORT``.
COLUMNS = (f"{R.LOGIC}_score", f"{R.GEOMETRY}_score", f"{R.PHYSICS}_score", f"{R.TEMPORAL}_score", f"{R.REFERENCE}_score")


def settle(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator that yields each once.

    Columns that later expressions use many times are computed before it, once; without it the
    optimizer would merge the projections and repeat their expressions in every use.
    """
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def constraint_score(details: str = "industrial_constraint_details") -> Column:
    """Share of the invariants checked that were not violated, 0..1; null where none was checked."""
    checked, broken = F.size(f"{details}.invariants_checked"), F.size(f"{details}.violations")
    return F.when(checked > 0, F.greatest(F.lit(0.0), 1.0 - broken / checked.cast("double")))


def measurements(results: DataFrame) -> DataFrame:
    """One row a delivered result: names in canonical form, axes as measured or null.

    ``motion`` is the fidelity of the motion to its target (0..100), ``angle`` the motion itself in degrees.  Results
    that have no ``viewpoint_motion`` keep no angle; their fidelity then stands in for it.
    """
    motion = A.measured(F.col("viewpoint_motion_score"))
    angle = A.measured(F.col("viewpoint_motion")) if "viewpoint_motion" in results.columns else motion
    rows = results.select(
        "result_id",
        "model_id",
        "task_id",
        "run_at",
        F.coalesce("skipped", F.lit(False)).alias("skipped"),
        "skip_reason",
        A.canonical_domain(F.col("domain")).alias("domain"),
        A.canonical_task(F.col("task_category")).alias("task_category"),
        A.tidy(F.col("motion_type")).alias("motion_type"),
        *(A.measured(F.col(c)).alias(s) for c, s in zip(COLUMNS, SHORT)),
        motion.alias("motion"),
        angle.alias("angle"),
        F.col("scored").isNotNull().alias("has_score"),
        constraint_score().alias("constraint"),
        F.col("industrial_constraint_details.violations").alias("violations"),
        F.col("industrial_constraint_details.invariants_checked").alias("invariants"),
    )
    return settle(rows)


def folded(rows: DataFrame) -> DataFrame:
    """Motion folded into reference, constraints into geometry, and floors applied."""
    rows = rows.withColumns({"reference": A.fold_motion(F.col("reference"), F.col("motion")), "geometry": A.fold_constraint(F.col("geometry"), F.col("constraint"))})
    return settle(rows.withColumns({s: A.floored(axis, F.col(s)) for s, axis in zip(SHORT, R.AXES)}))


def sample_weights(samples: DataFrame) -> DataFrame:
    """(task_id, w_logic .. w_reference) by the last delivery of each sample: its own weights, axes it does not name
    weighing 1, or where it has none the profile of its category, declared or inferred."""
    rows = infer_task_category(latest(samples))
    own = F.transform_keys("axis_weights", lambda k, _: A.canonical_axis(k))
    profile = F.try_element_at(F.create_map(*[x for t, w in R.TASK_WEIGHTS.items() for x in (F.lit(t), R.literal_map(dict(zip(R.AXES, w))))]), F.col("inferred_task"))
    given = F.coalesce(F.size("axis_weights") > 0, F.lit(False))
    rows = rows.withColumn("weights", F.when(given, own).otherwise(profile))
    return rows.select("task_id", *(F.coalesce(F.try_element_at("weights", F.lit(axis)), F.lit(1.0)).alias(f"w_{s}") for s, axis in zip(SHORT, R.AXES)))


def score_samples(rows: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Adds weighted_score, num_axes, rif, rif_gated, strict and gate: one wide projection.

    Profiles are five constant rows and join by broadcast; an unknown category takes the default one.
    ``weights`` (``sample_weights``) go before the profile of a result's category.
    """
    profiles = R.task_profiles(rows.sparkSession)
    rows = folded(rows).withColumn("profile", F.when(F.col("task_category").isin(*R.TASK_WEIGHTS), F.col("task_category")).otherwise(R.DEFAULT_TASK))
    rows = rows.join(F.broadcast(profiles.withColumnRenamed("task_category", "profile")), "profile")
    if weights is not None:
        rows = rows.join(weights.select("task_id", *(F.col(f"w_{s}").alias(f"own_{s}") for s in SHORT)), "task_id", "left")
        rows = rows.withColumns({f"w_{s}": F.coalesce(f"own_{s}", f"w_{s}") for s in SHORT}).drop(*(f"own_{s}" for s in SHORT))
    present = [F.when(F.col(s).isNotNull(), 1).otherwise(0) for s in SHORT]
    total = sum((F.coalesce(F.col(s) * F.col(f"w_{s}"), F.lit(0.0)) for s in SHORT[1:]), F.coalesce(F.col("logic") * F.col("w_logic"), F.lit(0.0)))
    weight = sum((F.when(F.col(s).isNotNull(), F.col(f"w_{s}")).otherwise(0.0) for s in SHORT[1:]), F.when(F.col("logic").isNotNull(), F.col("w_logic")).otherwise(0.0))
    rif = A.rif(F.col("logic"), F.col("geometry"), F.col("reference"))
    rows = rows.withColumns({"num_axes": sum(present[1:], present[0]), "weighted_score": F.coalesce(F.try_divide(total, weight), F.lit(0.0)), "rif": rif})
    rows = settle(rows.drop("profile", *(f"w_{s}" for s in SHORT)))
    rows = rows.withColumns({"rif_gated": A.rif_gate(F.col("rif"), F.when(F.col("angle").isNotNull(), F.greatest(F.col("angle"), F.lit(0.0)))), "strict": A.strict_pass(*(F.col(s) for s in SHORT)), "gate": A.gate_multiplier(F.col("motion"))})
    return rows


def scored(results: DataFrame) -> DataFrame:
    return score_samples(measurements(results))


def completed(rows: DataFrame) -> DataFrame:
    """Results that ran, as reports count them; metrics also ask for a score (``counted``)."""
    return rows.where(~F.col("skipped"))


def counted() -> Column:
    """Whether a result counts in the metrics of its model: it ran and was scored."""
    return ~F.col("skipped") & F.col("has_score")


def long_form(rows: DataFrame, *keep: str) -> DataFrame:
    """One row an axis that is present: axis, axis_ord, score."""
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(i).alias("axis_ord"), F.col(s).alias("score")) for i, (a, s) in enumerate(zip(R.AXES, SHORT))))
    return rows.select(*keep, F.inline(axes)).where(F.col("score").isNotNull())


def alias_long(results: DataFrame) -> DataFrame:
    """Axes under the short names by which they are delivered, made canonical."""
    short = ("ika", "gi", "pp", "tc", "vf", "vfa")
    pairs = F.array(*(F.struct(F.lit(a).alias("alias"), A.measured(F.col(c)).alias("score")) for a, c in zip(short, (*COLUMNS, "viewpoint_motion_score"))))
    rows = results.select("result_id", F.inline(pairs)).where(F.col("score").isNotNull())
    return rows.select("result_id", A.canonical_axis(F.col("alias")).alias("axis"), "score")


def dispatch(rows: DataFrame) -> DataFrame:
    """The constraint checkers of each row: by domain and topology, else by task category."""
    spark = rows.sparkSession
    table, other = R.checkers(spark), R.fallback_checkers(spark)
    rows = rows.join(F.broadcast(table), ["domain", "topology"], "left").join(F.broadcast(other), "task_category", "left")
    return rows.withColumn("checkers", F.coalesce("checkers", "fallback")).drop("fallback")
