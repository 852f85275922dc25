"""Model metrics, breakdowns, diagnostic reports, calibration and the leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom import registry as R
from benchloom.functions import axes as A
from benchloom.operators.dataops import latest
from benchloom.operators.order import medians
from benchloom.operators.scoring import SHORT, completed, counted, long_form
from benchloom.session import cut

NO_ROWS = "no_completed_samples"


def rate(condition: Column) -> Column:
    """Share of rows that meet a condition, unknown counting as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def _metrics() -> list[Column]:
    done = counted()
    pick = lambda c: F.when(done, c)
    return [
        F.count("*").alias("num_samples_total"),
        F.count_if(done).alias("num_samples_completed"),
        F.count_if(~done).alias("num_samples_skipped"),
        F.avg(pick(F.col("weighted_score"))).alias("relax_score"),
        F.avg(pick(F.col("strict").cast("int").cast("double"))).alias("strict_pass_rate"),
        F.avg(pick(F.col("weighted_score") * F.col("gate"))).alias("gated_score"),
        F.avg(pick(F.col("angle"))).alias("mean_motion"),
        *(F.avg(pick(F.col(s))).alias(s) for s in SHORT),
    ]


def _finish(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Floors on the means, RIF of the means, tier, gate, and the zero row of groups without results."""
    means = {s: A.floored(axis, F.col(s)) for s, axis in zip(SHORT, R.AXES)}
    rows = rows.withColumns(means).withColumn("rif", A.rif(F.col("logic"), F.col("geometry"), F.col("reference")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    static = F.col("mean_motion") < R.STATIC
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(
        *keys,
        count("num_samples_total"),
        count("num_samples_completed"),
        count("num_samples_skipped"),
        zero("relax_score"),
        zero("strict_pass_rate"),
        zero("gated_score"),
        F.coalesce("gated_score", F.lit(0.0)).alias("overall"),
        *SHORT,
        A.motion_tier(F.col("mean_motion")).alias("motion_tier"),
        "rif",
        A.rif_gate(F.col("rif"), F.col("mean_motion")).alias("rif_gated"),
        F.when(static, "rotation_integrity_factor_excluded_static_video").alias("rif_note"),
        F.when(F.coalesce("num_samples_completed", F.lit(0)) == 0, NO_ROWS).alias("note"),
    )


def model_metrics(scored: DataFrame, models: DataFrame) -> DataFrame:
    """Every model, also those without results: one shuffle by model, after partial aggregation."""
    rows = scored.groupBy("model_id").agg(*_metrics())
    return _finish(models.select("model_id", "model_name").join(rows, "model_id", "left"), ["model_id", "model_name"])


def breakdowns(scored: DataFrame) -> DataFrame:
    """Metrics by model, by model and domain, by model and task category, in one pass over the rows."""
    cube = scored.groupingSets([["model_id"], ["model_id", "domain"], ["model_id", "task_category"]], "model_id", "domain", "task_category")
    rows = cube.agg(*_metrics(), F.grouping("domain").alias("g_domain"), F.grouping("task_category").alias("g_task"))
    level = F.when(F.col("g_domain") == 0, "domain").when(F.col("g_task") == 0, "task_category").otherwise("model")
    rows = rows.withColumn("level", level).where((F.col("level") == "model") | F.coalesce("domain", "task_category").isNotNull())
    out = _finish(rows, ["model_id", "level", "domain", "task_category"])
    low = lambda c: F.coalesce(F.col(c), F.lit(100.0)) < R.LOW_FIDELITY
    return out.withColumn("physics_low", low("physics")).withColumn("geometry_low", low("geometry"))


def low_fidelity(broken_down: DataFrame) -> DataFrame:
    """For each model the domains with low physics and with low geometry."""
    rows = broken_down.where("level = 'domain'")
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c), F.col("domain")))), ",")
    return rows.groupBy("model_id").agg(names("physics_low").alias("physics_low_domains"), names("geometry_low").alias("geometry_low_domains"))


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Ranked by gated score, then name; no shared ranks."""
    order = Window.orderBy(F.round(F.col("overall") + 1e-9, 6).desc(), "model_name", "model_id")
    return metrics.withColumn("rank", F.row_number().over(order))


def leaderboard_markdown(ranked: DataFrame) -> DataFrame:
    """One markdown table row a model, null as a dash."""
    cells = [F.col("rank").cast("string"), F.col("model_name"), *(A.one_decimal(F.col(c)) for c in ("overall", "relax_score", *SHORT))]
    return ranked.select("rank", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def axis_statistics(scored: DataFrame) -> DataFrame:
    rows = cut(long_form(completed(scored)).select("axis", "score"))
    stats = rows.groupBy("axis").agg(F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"), F.count("*").alias("n"), rate(F.col("score") < R.LOW).alias("low_rate"))
    return stats.join(medians(rows, ["axis"], "score", written=True), "axis")


def group_scores(scored: DataFrame, samples: DataFrame) -> DataFrame:
    """Scores by domain, primary and sub topology, and kind of motion, in one pass; groups without name are dropped.

    A result's topologies are those of the last delivery of its sample.
    """
    shapes = latest(samples).select("task_id", F.coalesce(F.nullif("primary_topology", F.lit("")), F.nullif("topology_type", F.lit("")), F.lit("kinematic")).alias("primary_topology"), F.coalesce("sub_topology", F.lit("")).alias("sub_topology"))
    props = ("domain", "primary_topology", "sub_topology", "motion_type")
    rows = completed(scored).where("has_score").join(shapes, "task_id", "left")
    rows = rows.select("weighted_score", F.inline(F.array(*(F.struct(F.lit(p).alias("property"), F.col(p).alias("value")) for p in props)))).where(F.col("value").isNotNull())
    return rows.groupBy("property", "value").agg(F.count("*").alias("n"), F.avg("weighted_score").alias("mean_weighted_score"), rate(F.col("weighted_score") < R.LOW).alias("low_rate"))


def motion_diagnostics(clips: DataFrame) -> DataFrame:
    """Over clips that ran, with motion, target and fidelity: errors, static and low ones, and those whose motion could not be calculated."""
    ran = clips.where(~F.coalesce("skipped", F.lit(False))).withColumn("error", F.abs(F.col("motion") - F.col("target")))
    stats = ran.agg(
        F.count("error").alias("targeted"),
        F.avg("error").alias("mean_abs_error"),
        F.count_if(F.col("uncalculable")).alias("uncalculable"),
        F.count_if(F.col("motion") < R.STATIC).alias("static"),
        F.count_if(F.col("fidelity") < R.LOW).alias("low"),
    )
    middle = medians(ran.withColumn("all", F.lit(1)), ["all"], "error").select(F.col("median").alias("median_abs_error"))
    return stats.join(middle, how="left")


def constraint_counts(scored: DataFrame) -> DataFrame:
    """How often each checker ran and each violation occurred, most frequent first."""
    kinds = F.explode(F.array(F.struct(F.lit("checker").alias("kind"), F.col("invariants").alias("names")), F.struct(F.lit("violation").alias("kind"), F.transform("violations", A.violation_label).alias("names"))))
    rows = completed(scored).select("result_id", kinds.alias("k")).select("result_id", "k.kind", F.explode("k.names").alias("name"))
    counts = rows.groupBy("kind", "name").agg(F.count("*").alias("n"), F.min("result_id").alias("first_seen"))
    return counts.withColumn("position", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "first_seen", "name")))


def constraint_summary(scored: DataFrame) -> DataFrame:
    return completed(scored).agg(F.avg(A.normalise_constraint(F.col("constraint"))).alias("mean_constraint"), F.count("constraint").alias("with_constraint"))


def ability_failures(scored: DataFrame) -> DataFrame:
    """For each axis how many results are low, and in which domains and categories."""
    rows = long_form(completed(scored), "domain", "task_category").withColumn("low", F.col("score") < R.LOW)
    whole = rows.groupBy("axis").agg(F.avg("score").alias("mean"), F.count_if("low").alias("low_count"), rate(F.col("low")).alias("low_rate"))
    out = whole
    for key in ("domain", "task_category"):
        counts = rows.where(F.col("low") & F.col(key).isNotNull()).groupBy("axis", key).agg(F.count("*").alias("n"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(key).alias("k")))), lambda x: F.concat(x["k"], F.lit("="), (-x["n"]).cast("string"))), ",")
        out = out.join(counts.groupBy("axis").agg(text.alias(f"by_{key}")), "axis", "left")
    return out


def weakest_axes(statistics: DataFrame, k: int = 5) -> DataFrame:
    return statistics.select("axis", "mean").orderBy("mean", "axis").limit(k)


def worst_samples(scored: DataFrame, k: int = 12) -> DataFrame:
    """The k lowest results, each with its weakest axis (a top-k, never a full sort)."""
    rows = completed(scored).orderBy("weighted_score", "result_id").limit(k)
    return rows.join(weakest_axis(rows), "result_id", "left").select("result_id", "task_id", "domain", "motion_type", "weighted_score", "weakest_axis", "weakest_score", "motion")


def weakest_axis(rows: DataFrame) -> DataFrame:
    """(result_id, weakest_axis, weakest_score); the first in the order of axes wins ties."""
    entries = F.array_compact(F.array(*(F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("score"), F.lit(i).alias("ord"), F.lit(a).alias("axis"))) for i, (a, s) in enumerate(zip(R.AXES, SHORT)))))
    low = F.array_min(entries)
    return rows.select("result_id", low["axis"].alias("weakest_axis"), low["score"].alias("weakest_score"))


def worst_per_axis(scored: DataFrame, k: int = 8) -> DataFrame:
    """The k lowest results of each axis; partitions keep only their own k before the shuffle."""
    rows = long_form(completed(scored), "result_id", "task_id", "domain", "task_category")
    rank = F.row_number().over(Window.partitionBy("axis").orderBy("score", "result_id"))
    return rows.withColumn("position", rank).where(F.col("position") <= k).drop("axis_ord")


def calibration(scored: DataFrame, samples: DataFrame, axis: str = "overall") -> DataFrame:
    """Mean score by difficulty against its target; buckets without results have mean 0."""
    profile = F.col("difficulty_profile")
    tasks = latest(samples).where(F.size(profile) > 0)
    bucket = A.worst_bucket(profile) if axis == "overall" else A.axis_bucket(profile, R.AXES[SHORT.index(axis)])
    score = "weighted_score" if axis == "overall" else axis
    rows = completed(scored).join(tasks.select("task_id", bucket.alias("bucket")), "task_id").groupBy("bucket").agg(F.avg(score).alias("mean"), F.count(score).alias("n"))
    targets = scored.sparkSession.createDataFrame(list(R.BUCKET_TARGETS.items()), "bucket string, target double")
    out = F.broadcast(targets).join(rows, "bucket", "left").withColumn("mean", F.coalesce("mean", F.lit(0.0))).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("above_target", F.col("mean") > F.col("target"))


def image_reuse(samples: DataFrame) -> DataFrame:
    """Each sample with the number of samples that share its image; partial counts, then a join."""
    counts = samples.groupBy("image_path").agg(F.count("*").alias("reuse"))
    return samples.select("row_id", "task_id", "image_path").join(counts.where(F.col("image_path").isNotNull()), "image_path", "left")
