"""Reports as documents: JSON of one row each, and Markdown as ordered lines.

What goes into one JSON document is bounded by the number of axes, domains, categories, checkers or
models, or by a stated top k.  Anything that grows with the data (flagged samples, prompts, plans) is a
relation of lines with the columns by which they are sorted, so that it can be written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom import registry as R
from benchloom.functions import axes as A
from benchloom.operators import aggregate as G
from benchloom.operators import dataops as D
from benchloom.operators.scoring import SHORT, completed, counted


def rounded(x: Column, digits: int = 4) -> Column:
    """Rounded; null, NaN and infinities as null."""
    return F.round(A.sanitize(x.cast("double")), digits)


def _tidy(df: DataFrame) -> list[Column]:
    """All columns, doubles rounded."""
    return [rounded(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]


def sorted_by(rows: Column, *keys: str) -> Column:
    """Structs in the order of some of their fields (the others may be maps, which have no order)."""
    key = lambda r: F.struct(*(r[k].alias(k) for k in keys))
    return F.array_sort(rows, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def as_map(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row (k, name): a map from a small table's key to the rest of its row."""
    value = F.struct(*(c for c in _tidy(df.drop(key))))
    return df.where(F.col(key).isNotNull()).agg(F.map_from_entries(sorted_by(F.collect_list(F.struct(F.col(key).alias("key"), value.alias("value"))), "key")).alias(name)).withColumn("k", F.lit(1))


def as_list(df: DataFrame, name: str, *order: str) -> DataFrame:
    """One row (k, name): a small table as a list in order."""
    row = F.struct(*order, F.struct(*_tidy(df)).alias("row"))
    return df.agg(F.transform(sorted_by(F.collect_list(row), *order), lambda r: r["row"]).alias(name)).withColumn("k", F.lit(1))


def as_object(df: DataFrame, name: str) -> DataFrame:
    """One row (k, name) out of a table of one row."""
    return df.select(F.struct(*_tidy(df)).alias(name)).withColumn("k", F.lit(1))


def together(*parts: DataFrame) -> DataFrame:
    """The columns of tables of one row, side by side."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part), "k")
    return out.drop("k")


def to_json(row: Column) -> Column:
    """JSON with nulls kept; what cannot be serialised becomes an error document."""
    return F.coalesce(F.to_json(row, {"ignoreNullFields": "false"}), F.lit('{"error":"not serialisable"}'))


def axis_scores(prefix: str = "") -> Column:
    """A map from axes to those means that are not null."""
    whole = F.map_from_arrays(F.array(*map(F.lit, R.AXES)), F.array(*(rounded(F.col(prefix + s)) for s in SHORT)))
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def aggregate_documents(metrics: DataFrame, broken_down: DataFrame) -> DataFrame:
    """(model_name, document): the aggregate of each model with its breakdowns and what is low in them."""
    numbers = ("relax_score", "strict_pass_rate", "gated_score", "overall", "rif", "rif_gated")
    body = lambda: [axis_scores().alias("axis_scores"), *(rounded(F.col(c)).alias(c) for c in numbers), "rif_note", F.col("motion_tier").alias("viewpoint_motion_tier"), "num_samples_total", "num_samples_completed", "num_samples_skipped", "note"]
    flags = F.struct(F.col("physics_low").alias("physical_plausibility_low"), F.col("geometry_low").alias("geometric_integrity_low"))
    groups = broken_down.where(F.col("level") != "model").select("model_id", "level", F.coalesce("domain", "task_category").alias("group"), F.struct(*body(), F.col("num_samples_total").alias("num_samples"), flags.alias("low_fidelity_flags")).alias("body"))
    pick = lambda level: F.map_from_entries(sorted_by(F.collect_list(F.when(F.col("level") == level, F.struct("group", "body"))), "group"))
    low = lambda c: F.array_sort(F.collect_list(F.when((F.col("level") == "domain") & F.col(f"body.low_fidelity_flags.{c}"), F.col("group"))))
    summary = F.struct(low("physical_plausibility_low").alias("domains_physical_low"), low("geometric_integrity_low").alias("domains_geometric_low"))
    per_model = groups.groupBy("model_id").agg(pick("domain").alias("domain_breakdown"), pick("task_category").alias("task_breakdown"), summary.alias("low_fidelity_summary"))
    rows = metrics.join(per_model, "model_id", "left")
    return rows.select("model_name", to_json(F.struct(*body(), "domain_breakdown", "task_breakdown", F.array(*map(F.lit, R.AXES)).alias("model_evaluation_axes"), "low_fidelity_summary")).alias("document"))


def report_document(scored: DataFrame, samples: DataFrame, model: str) -> DataFrame:
    """(document): the diagnostic report of the results given, which are those of one model."""
    stats = G.axis_statistics(scored)
    groups = G.group_scores(scored, samples)
    by = lambda prop: as_map(groups.where(F.col("property") == prop).drop("property"), "value", f"by_{prop}")
    totals = scored.agg(F.count("*").alias("num_samples_total"), F.count_if(~F.col("skipped")).alias("num_samples_completed"), F.count_if(F.col("skipped")).alias("num_samples_skipped"))
    weakest = as_list(G.weakest_axes(stats).join(stats.select("axis", "low_rate"), "axis"), "weakest_axes", "mean", "axis")
    counts = G.constraint_counts(scored)
    times = lambda kind: as_map(counts.where(F.col("kind") == kind).select("name", "n"), "name", f"{kind}_counts")
    worst = as_list(G.worst_per_axis(scored).select("axis", "position", "task_id", "domain", "task_category", "score"), "worst_per_axis", "axis", "position")
    parts = [
        as_object(totals, "summary"), weakest, as_map(stats, "axis", "axis_statistics"), *(by(p) for p in ("domain", "primary_topology", "sub_topology", "motion_type")),
        as_object(G.constraint_summary(scored), "industrial_constraint_diagnostics"), times("checker"), times("violation"),
        as_map(G.ability_failures(scored), "axis", "ability_failure_report"), worst, as_list(G.worst_samples(scored), "worst_samples", "weighted_score", "result_id"),
    ]
    row = together(*parts)
    return row.select(to_json(F.struct(F.lit(model).alias("model"), *row.columns)).alias("document"))


def leaderboard_document(ranked: DataFrame) -> DataFrame:
    """(document): all models by rank."""
    rows = ranked.select("rank", F.col("model_name").alias("model"), "overall", axis_scores().alias("axis_scores"), F.coalesce("motion_tier", F.lit("unknown")).alias("viewpoint_motion_tier"), "rif", "rif_gated", "num_samples_completed", "num_samples_total")
    row = as_list(rows, "models", "rank").select("models", F.size("models").alias("num_models"))
    return row.select(to_json(F.struct("models", "num_models")).alias("document"))


def calibration_document(calibrated: DataFrame, model: str, axis: str = "overall") -> DataFrame:
    """(document, console): buckets, flags of those above their target, and the same as text of fixed width."""
    rank = F.array_position(F.array(*map(F.lit, R.BUCKET_TARGETS)), F.col("bucket")).cast("int")
    rows = calibrated.select(rank.alias("at"), "bucket", F.round("mean", 2).alias("mean_score"), "target", F.col("n").alias("n_samples"), "above_target", "mean")
    flag = F.when(F.col("above_target"), F.format_string("BENCHMARK TOO EASY — %s mean %.1f > target %.0f — consider tightening thresholds", "bucket", "mean", "target"))
    status = F.when(F.col("above_target"), "FAIL").otherwise("OK")
    line = F.format_string("%-14s %8.2f %8.0f %5d %10s", "bucket", "mean", "target", F.col("n_samples"), status)
    # A few rows: one a bucket.
    listed = F.array_sort(F.collect_list(F.struct("at", F.struct("bucket", "mean_score", "target", "n_samples", "above_target").alias("b"), flag.alias("flag"), line.alias("line"))))
    one = rows.agg(listed.alias("x"))
    buckets = F.map_from_entries(F.transform("x", lambda r: F.struct(r["b"]["bucket"], r["b"])))
    flags = F.array_compact(F.transform("x", lambda r: r["flag"]))
    rule, header = "-" * 60, f"{'Bucket':<14} {'Mean':>8} {'Target':>8} {'N':>5} {'Status':>10}"
    lines = F.concat(F.array(*(F.lit(t) for t in (f"Calibration report for model: {model}", f"Axis: {axis}", rule, header, rule))), F.transform("x", lambda r: r["line"]), F.array(F.lit(rule)), F.when(F.size(flags) > 0, F.transform(flags, lambda f: F.concat(F.lit("  ! "), f))).otherwise(F.array(F.lit("  All buckets within calibration targets."))))
    return one.select(to_json(F.struct(F.lit(model).alias("model"), F.lit(axis).alias("axis"), buckets.alias("buckets"), flags.alias("flags"))).alias("document"), F.array_join(lines, "\n").alias("console"))


def audit_document(audited: DataFrame, samples: DataFrame) -> DataFrame:
    """(document): counts of an audit, stamped with the time in UTC; the flagged rows themselves are ``audit_lines``."""
    whole = audited.agg(
        F.count("*").alias("total_samples"),
        F.count_if(F.col("severity") == "none").alias("static_excluded_from_verb_check"),
        F.count_if(F.size("issues") > 0).alias("flagged_count"),
        F.struct(*(F.count_if((F.size("issues") > 0) & (F.col("severity") == s)).alias(s) for s in ("high", "medium", "low"))).alias("severity_counts"),
    ).withColumn("k", F.lit(1))
    issues = as_map(audited.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")), "issue", "issue_counts")
    motions = as_map(samples.select(F.coalesce(A.tidy(F.col("motion_type")), F.lit("none")).alias("motion")).groupBy("motion").agg(F.count("*").alias("n")), "motion", "motion_type_counts")
    row = together(whole, issues, motions)
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return row.select(to_json(F.struct(stamp.alias("audited_at"), F.lit("prompt").alias("field"), *row.columns)).alias("document"))


def lines(rows: DataFrame, order: list[str], *text: Column) -> DataFrame:
    """(order columns, line_no, line): several lines of text for each row; null lines are left out."""
    return rows.select(*order, F.posexplode(F.array(*text)).alias("line_no", "line")).where(F.col("line").isNotNull())


def item(name: str, column: str | Column) -> Column:
    """``- name: `value` ``, an empty value for null."""
    return F.concat(F.lit(f"- {name}: `"), F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")), F.lit("`"))


def fenced(column: str) -> list[Column]:
    return [F.lit("```text"), F.coalesce(column, F.lit("")), F.lit("```"), F.lit("")]


def audit_lines(audited: DataFrame, samples: DataFrame) -> DataFrame:
    """The details of an audit in Markdown, by severity and task."""
    rows = D.review_order(audited).join(samples.select("row_id", "domain", "task_category", "viewpoint_motion_target", "image_path"), "row_id")
    heading = F.concat(F.lit("### `"), F.coalesce("task_id", F.lit("")), F.lit("` — "), "severity")
    issues = F.array_join(F.transform("issues", lambda i: F.concat(F.lit("  - "), i)), "\n")
    body = [heading, F.lit(""), item("domain", "domain"), item("task_category", "task_category"), item("motion_type", "motion"), item("viewpoint_motion_target", "viewpoint_motion_target"), item("reference_subject", "subject"), item("image_path", "image_path"), F.lit("- issues:"), issues, F.lit("- motion clause:"), *fenced("clause")]
    return lines(rows, ["rank", "task_id", "row_id"], *body)


def prompt_lines(samples: DataFrame) -> DataFrame:
    """All prompts in Markdown in reading order, with headings where domain or category change."""
    rows = D.export_rows(samples).join(D.export_headers(samples), "task_id")
    blank = lambda c: F.when(F.col(c).isNotNull(), F.lit(""))
    body = [F.col("domain_header"), blank("domain_header"), F.col("task_header"), blank("task_header"), F.concat(F.lit("#### `"), "task_id", F.lit("`")), F.lit("")]
    body += [item("image", "image_path"), item("motion_type", "motion_type"), item("viewpoint_motion_target", "viewpoint_motion_target"), F.lit(""), F.lit("Generation prompt:"), F.lit(""), *fenced("video_generation_prompt"), F.lit("Evaluation prompt:"), F.lit(""), *fenced("prompt")]
    return lines(rows.withColumns({"domain": F.coalesce("domain", F.lit("")), "task_category": F.coalesce("task_category", F.lit(""))}), ["domain", "task_category", "task_id"], *body)


def sourcing_lines(plan: DataFrame) -> DataFrame:
    """The rows of a sourcing plan whose image is missing or reused, in Markdown."""
    body = [F.concat(F.lit("## `"), "task_id", F.lit("`")), F.lit(""), item("domain", "domain"), item("task_category", "task_category"), item("current_image_path", "current_image_path"), item("current_image_reuse_count", "current_image_reuse_count")]
    body += [F.concat(F.lit("- scenario: "), "core_scenario"), F.concat(F.lit("- requirement: "), "image_requirement"), item("recommended_search_query", "recommended_search_query"), item("local_candidate_images", "local_candidate_images"), F.lit(""), *fenced("video_generation_prompt")]
    return lines(D.to_review(plan), ["task_id"], *body)


def skipped(samples: DataFrame, videos: DataFrame) -> DataFrame:
    """(task_id, skip_reason): samples without a video (``videos``: task_id, frames, failed), with an empty one, or whose evaluation failed."""
    rows = samples.select("task_id").where(F.col("task_id").isNotNull()).distinct().join(videos.select("task_id", F.lit(True).alias("there"), "frames", "failed"), "task_id", "left")
    reason = F.when(F.col("there").isNull(), "video_not_found").when(F.coalesce("frames", F.lit(0)) == 0, "empty_video").when(F.coalesce("failed", F.lit(False)), "evaluation_error")
    return rows.select("task_id", reason.alias("skip_reason")).where(F.col("skip_reason").isNotNull())


def upsert_manifest(manifest: DataFrame, curated: DataFrame) -> DataFrame:
    """A new manifest: rows with a curated image of their local path take its size and status, others keep theirs."""
    extra = ("curated_width", "curated_height", "curated_bytes", "curation_status")
    keep = [F.col(c) for c in manifest.columns if c not in extra]
    rows = manifest.join(curated.select("local_path", *(F.col(c).cast("string").alias(f"new_{c}") for c in extra)), "local_path", "left")
    old = lambda c: F.col(c).cast("string") if c in manifest.columns else F.lit(None).cast("string")
    return rows.select(*keep, *(F.coalesce(f"new_{c}", old(c)).alias(c) for c in extra))


def completed_counts(scored: DataFrame) -> DataFrame:
    """(model_id, ran, counted): results that ran, and those of them that were scored."""
    return completed(scored).groupBy("model_id").agg(F.count("*").alias("ran"), F.count_if(counted()).alias("counted"))
