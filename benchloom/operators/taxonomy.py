"""Task categories out of what a sample says of itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom import registry as R
from benchloom.functions import axes as A
from benchloom.functions import text as T


def searchable(prompt: Column, image: Column, task: Column) -> Column:
    """Prompt (unless it is a template), file name and id, in lower case."""
    low = F.lower(F.coalesce(prompt, F.lit("")))
    own = F.when(low.startswith("task objective:"), F.lit("")).otherwise(low)
    file = F.regexp_extract(F.lower(F.coalesce(image, F.lit(""))), r"([^/\\]*)$", 1)
    return F.concat_ws(" ", own, file, F.lower(F.coalesce(task, F.lit(""))))


def infer_task_category(samples: DataFrame) -> DataFrame:
    """Adds ``inferred_task``: a declared category, else rules on words, topology and motion."""
    declared, domain = A.canonical_task(F.col("task_category")), A.canonical_domain(F.col("domain"))
    topology = F.coalesce(F.nullif(F.col("primary_topology"), F.lit("")), F.col("topology_type"), F.lit(""))
    sub, motion = F.coalesce("sub_topology", F.lit("")), F.coalesce(A.tidy(F.col("motion_type")), F.lit(""))
    rows = samples.withColumns({"_text": searchable(F.col("prompt"), F.col("image_path"), F.col("task_id")), "_declared": declared, "_domain": F.coalesce(domain, F.lit(""))})
    says = lambda terms: T.any_term(F.col("_text"), terms)
    rigid = says(R.RIGID_TERMS)
    first = F.coalesce(F.try_element_at(R.literal_map(R.DOMAIN_TASKS), F.col("_domain")), F.lit(R.DEFAULT_TASK))
    category = (
        F.when(F.col("_declared").isin(*R.TASK_WEIGHTS), F.col("_declared"))
        .when((F.col("_domain") == "visual_security") | says(R.LOGIC_TERMS), "industrial_logic_and_compliance")
        .when(says(R.FLUID_TERMS), "fluid_dynamics_and_thermodynamics")
        .when(says(R.FAILURE_TERMS) | sub.isin("2d_planar", "rotational") | (topology == "lattice"), "topology_mutation_and_failure")
        .when((says(R.VIEWPOINT_TERMS) | motion.isin("orbit", "pan", "dolly", "crane", "tilt")) & ~rigid, "spatial_exploration_and_viewpoint")
        .when(rigid | topology.isin("kinematic", "flexible"), "rigid_body_kinematics_and_coupling")
        .otherwise(first)
    )
    return rows.withColumn("inferred_task", category).drop("_text", "_declared", "_domain")


def effective_weights(samples: DataFrame) -> DataFrame:
    """(row_id, axis, weight): base 1.0, then the sample's own, then its category's profile."""
    own = F.transform_keys(F.coalesce("axis_weights", F.create_map().cast("map<string,double>")), lambda k, _: A.canonical_axis(k))
    profile = F.try_element_at(F.create_map(*[x for t, w in R.TASK_WEIGHTS.items() for x in (F.lit(t), R.literal_map(dict(zip(R.AXES, w))))]), F.col("inferred_task"))
    base = R.literal_map({a: 1.0 for a in R.AXES})
    merged = F.map_concat(base, own, F.coalesce(profile, F.create_map().cast("map<string,double>")))
    return infer_task_category(samples).select("row_id", F.explode(merged).alias("axis", "weight"))
