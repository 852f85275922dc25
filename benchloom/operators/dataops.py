"""Validation, audits, exports and image sourcing over the annotation layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom import registry as R
from benchloom.functions import axes as A
from benchloom.functions import text as T
from benchloom.session import join_dimension

#: Required fields of a sample.
REQUIRED = ("task_id", "domain", "topology_type", "image_path", "prompt", "video_generation_prompt", "motion_type", "viewpoint_motion_target", "difficulty_profile", "constraint_annotations", "industrial_logic_questions", "sensitivity_variants")


def rules() -> list[tuple[str, str, Column]]:
    """(path, rule, violated) of the annotation schema."""
    c = F.col
    out = [(f, "required", c(f).isNull()) for f in REQUIRED]
    out += [(f, "enum", ~c(f).isin(*values)) for f, values in R.ENUMS.items()]
    out += [("difficulty_profile", "enum", F.exists(F.map_values("difficulty_profile"), lambda v: ~v.isin(*R.BUCKET_TARGETS)))]
    target = c("viewpoint_motion_target")
    out += [("viewpoint_motion_target", "oneOf", target.try_cast("double").isNull() & ~target.rlike(r"^(orbit_(cw|ccw)_[0-9]+deg|crane_up_[0-9]+deg|horizontal_pan_lr|dolly_in_[0-9]+x)$"))]
    lacks = lambda x, *names: F.greatest(*(x[n].isNull() for n in names))
    out += [("industrial_logic_questions.items", "required", F.exists("industrial_logic_questions", lambda q: lacks(q, "id", "text", "answer")))]
    out += [("sensitivity_variants.items", "required", F.exists("sensitivity_variants", lambda v: lacks(v, "id", "difficulty", "prompt_delta", "viewpoint_motion_target_delta")))]
    out += [("task_id", "pattern", ~c("task_id").rlike(r"^[a-z]{2,8}(_[a-z]+){0,2}_[0-9]{3}$|^S[A-Z][0-9]{2}$")), ("image_path", "pattern", ~c("image_path").rlike(r"^dataset[\\/]images(_hq)?[\\/]"))]
    out += [(f, "minLength", F.char_length(f) < n) for f, n in (("prompt", 50), ("video_generation_prompt", 50), ("application_value", 20))]
    out += [("axis_weights", "minimum", F.exists(F.map_values("axis_weights"), lambda v: v < 0)), ("industrial_logic_questions", "minItems", F.size("industrial_logic_questions") < 3)]
    out += [("industrial_logic_questions.answer", "enum", F.exists("industrial_logic_questions", lambda q: ~q["answer"].isin("yes", "no"))), ("industrial_logic_questions.weakness_target", "pattern", F.exists("industrial_logic_questions", lambda q: ~q["weakness_target"].rlike("^W[2-7]$")))]
    return out


def violations(samples: DataFrame) -> DataFrame:
    """(row_id, task_id, path, rule): every rule that a sample breaks."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"))) for p, r, bad in rules())))
    return samples.select("row_id", "task_id", F.inline(broken))


def unknown_fields(records: DataFrame, known: tuple[str, ...] | list[str]) -> DataFrame:
    """(record, path) of fields that the schema does not have, of JSON records (record, json)."""
    fields = F.map_keys(F.try_variant_get(F.try_parse_json("json"), "$", "map<string,variant>"))
    return records.select("record", F.explode(F.array_except(fields, F.array(*map(F.lit, known)))).alias("path"))


def audit(samples: DataFrame) -> DataFrame:
    """Each sample's motion clause, the issues found in it and their severity."""
    motion = A.tidy(F.col("motion_type"))
    rows = samples.select("row_id", "task_id", motion.alias("motion"), F.coalesce(T.motion_clause(F.col("prompt")), F.lit("")).alias("clause"), F.coalesce(T.reference_subject(F.col("prompt")), F.lit("")).alias("subject"), F.col("viewpoint_motion_target").alias("target"))
    issues, severity = T.motion_audit(F.col("motion"), F.col("clause"), F.col("subject"), F.col("target"))
    return rows.select("row_id", "task_id", "motion", "clause", "subject", issues.alias("issues"), severity.alias("severity"))


def issue_counts(audited: DataFrame) -> DataFrame:
    """Counts by issue, by severity and by motion, each row once for each of its issues."""
    one = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    rows = audited.where("severity <> 'none'")
    issues = rows.select(F.explode("issues").alias("name")).select(F.lit("issue").alias("kind"), "name")
    rest = rows.where(F.size("issues") > 0).select(F.inline(F.array(one("severity", F.col("severity")), one("motion", F.coalesce("motion", F.lit("none"))))))
    return issues.unionByName(rest).groupBy("kind", "name").agg(F.count("*").alias("n"))


def issue_index(audited: DataFrame) -> DataFrame:
    """(issue, row_id, task_id): the inverted index, one row an entry; an issue's entries may be any number."""
    return audited.select(F.explode("issues").alias("issue"), "row_id", "task_id")


def review_order(audited: DataFrame) -> DataFrame:
    """Flagged rows with ``rank``, the place of their severity in the order of review; sort by rank, task_id, row_id."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    return audited.where(F.size("issues") > 0).withColumn("rank", rank)


def variant_flags(samples: DataFrame) -> DataFrame:
    """Prompt checks: the closing rule, and variants that speak of an orbit where there is none."""
    motion = A.tidy(F.col("motion_type"))
    rows = samples.select("row_id", motion.alias("motion"), F.col("video_generation_prompt").alias("text"), F.col("sensitivity_variants").alias("v"))
    suffix = rows.where(~F.col("text").endswith("No zoom.")).select("row_id", F.lit("missing_no_zoom_suffix").alias("flag"))
    told = rows.select("row_id", "motion", F.explode("v").alias("v")).where(F.lower("v.prompt_delta").contains("orbit") & (F.col("motion") != "orbit"))
    flag = F.concat(F.lit("variant_"), F.coalesce("v.difficulty", F.lit("any")), F.lit("_mentions_orbit_but_motion_is_"), F.col("motion"))
    return suffix.unionByName(told.select("row_id", flag.alias("flag")))


def latest(samples: DataFrame) -> DataFrame:
    """One row a task: the last delivery."""
    order = Window.partitionBy("task_id").orderBy(F.desc("ingested_at"), F.desc("row_id"))
    return samples.where(F.col("task_id").isNotNull()).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def export_rows(samples: DataFrame) -> DataFrame:
    """What a prompt export holds of each task; the generation prompt falls back to the other."""
    return latest(samples).select("task_id", "domain", "task_category", "image_path", "motion_type", "viewpoint_motion_target", F.coalesce("video_generation_prompt", "prompt").alias("video_generation_prompt"), "prompt")


def export_headers(samples: DataFrame) -> DataFrame:
    """Tasks in reading order with the headings at which domain or category change.

    Only the first task of each domain and of each category in it matters, so these are aggregates joined back.
    """
    rows = export_rows(samples).withColumns({"d": F.coalesce("domain", F.lit("")), "c": F.coalesce("task_category", F.lit(""))}).select("d", "c", "task_id")
    first_c = rows.groupBy("d", "c").agg(F.min("task_id").alias("first_c"))
    first_d = first_c.groupBy("d").agg(F.min(F.struct("c", "first_c")).alias("first_d"))
    heads = join_dimension(first_c, first_d, ["d"], "inner").select("d", "c", "first_c", F.col("first_d.first_c").alias("first_d"))
    rows = join_dimension(rows, heads, ["d", "c"])
    return rows.select("task_id", F.when(F.col("task_id") == F.col("first_d"), F.concat(F.lit("## "), "d")).alias("domain_header"), F.when(F.col("task_id") == F.col("first_c"), F.concat(F.lit("### "), "c")).alias("task_header"))


def keep_first(rows: DataFrame, text: str, key: str) -> DataFrame:
    """Within equal texts the first by ``key`` is kept, the others marked; grouped by hash, counts first.

    No window over copies: the kept key is an aggregate, joined back.
    """
    hashed = rows.where(F.col(text).isNotNull()).select(key, F.sha2(text, 256).alias("hash"))
    groups = hashed.groupBy("hash").agg(F.count("*").alias("copies"), F.min(key).alias("kept"))
    return hashed.join(groups, "hash").select(key, "hash", "copies", "kept", F.when(F.col(key) == F.col("kept"), "keep").otherwise("delete").alias("action"))


def candidates(queries: DataFrame, items: DataFrame, k: int = 5, bonus: int = 3) -> DataFrame:
    """The k items that share most tokens with each query; the item a query names gets a bonus.

    An equi-join on tokens: queries (query, words, current), items (item, words).  The tokens of an inventory of
    bounded size are broadcast, so that a token all queries share goes to no single task; those of a
    larger one are shuffled and adaptive execution splits the common ones.
    """
    q = queries.select("query", F.explode(F.array_distinct("words")).alias("token"))
    i = items.select("item", F.explode(F.array_distinct("words")).alias("token"))
    shared = join_dimension(q, i, ["token"], "inner").groupBy("query", "item").agg(F.count("*").alias("score"))
    named = queries.join(items.select(F.col("item").alias("current")), "current").select("query", F.col("current").alias("item"), F.lit(bonus).cast("bigint").alias("score"))
    scores = shared.unionByName(named).groupBy("query", "item").agg(F.sum("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return scores.withColumn("position", rank).where(F.col("position") <= k)


def inventory(paths: DataFrame) -> DataFrame:
    """(item, words) of image paths (path): the words of the last three parts of each, without its extension."""
    kind = F.lower("path").rlike(r"\.(jpg|jpeg|png|webp)$")
    last = F.array_join(F.slice(F.reverse(F.split(F.regexp_replace("path", r"\.[^.]*$", ""), "/")), 1, 3), " ")
    return paths.where(kind).select(F.col("path").alias("item"), T.tokens(last).alias("words")).distinct()


def sourcing_plan(samples: DataFrame, present: DataFrame) -> DataFrame:
    """Each task's image, whether it is there, how often it is reused, what it must show, a search query and the five nearest images there are."""
    there = present.select("image_path").where(F.col("image_path").isNotNull()).distinct()
    counts = samples.where(F.col("image_path").isNotNull()).groupBy("image_path").agg(F.count("*").alias("reuse"))
    known = lambda values, key: F.coalesce(F.try_element_at(R.literal_map(values), F.col(key)), F.lit(""))
    rows = latest(samples).select("task_id", "domain", "task_category", "image_path", "video_generation_prompt", F.coalesce(T.core_scenario(F.col("prompt")), F.lit("")).alias("core_scenario"))
    rows = rows.withColumns({"requirement": known(R.IMAGE_REQUIREMENTS, "task_category"), "search": known(R.SEARCH_WORDS, "domain"), "category": F.coalesce("task_category", F.lit(""))})
    query = F.trim(F.concat_ws(" ", "core_scenario", "search", F.replace("category", F.lit("_"), F.lit(" ")), F.lit("real industrial photo high resolution")))
    # Tasks that ask for the same are matched once.
    words = T.tokens(F.concat_ws(" ", F.coalesce("domain", F.lit("")), "category", "core_scenario", "search"))
    rows = rows.withColumns({"query_text": query, "words": F.array_sort(words)}).withColumn("query", F.xxhash64("words", "image_path"))
    asked = rows.select("query", "words", F.col("image_path").alias("current")).dropDuplicates(["query"])
    near = candidates(asked, inventory(there.withColumnRenamed("image_path", "path")))
    near = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("position", "item"))).alias("near"))
    rows = rows.join(near, "query", "left").join(counts, "image_path", "left").join(there.withColumn("image_exists", F.lit("yes")), "image_path", "left")
    return rows.select(
        "task_id",
        "domain",
        "task_category",
        "core_scenario",
        F.col("image_path").alias("current_image_path"),
        F.coalesce("image_exists", F.lit("no")).alias("image_exists"),
        F.coalesce("reuse", F.lit(0)).alias("current_image_reuse_count"),
        F.col("requirement").alias("image_requirement"),
        F.col("query_text").alias("recommended_search_query"),
        F.coalesce(F.array_join(F.transform("near", lambda x: x["item"]), " | "), F.lit("")).alias("local_candidate_images"),
        "video_generation_prompt",
    )


def to_review(plan: DataFrame) -> DataFrame:
    """Plan rows with a missing or reused image."""
    return plan.where((F.col("current_image_reuse_count") > 1) | (F.col("image_exists") == "no"))


def integrity(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """How many wanted keys there are, and how many are present or missing."""
    have = present.select(key).distinct().withColumn("there", F.lit(True))
    return wanted.where(F.col(key).isNotNull()).join(have, key, "left").agg(F.count("*").alias("total"), F.count_if("there").alias("found"), F.count_if(F.col("there").isNull()).alias("missing"))


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.where(F.col(key).isNotNull()).join(present.select(key), key, "left_anti")


def image_candidates(path: Column) -> Column:
    """Where a reference image may lie, best first."""
    hq = F.replace(path, F.lit("/images/"), F.lit("/images_hq/"))
    return F.array_distinct(F.array(F.concat(F.regexp_replace(hq, r"\.[^.]*$", ""), F.lit(".png")), hq, path))


def resolve_images(samples: DataFrame, present: DataFrame) -> DataFrame:
    """The first candidate path that exists; null where none does."""
    rows = samples.where(F.col("image_path").isNotNull()).select("row_id", F.posexplode(image_candidates(F.col("image_path"))).alias("at", "path"))
    hit = rows.join(present.select(F.col("image_path").alias("path")).distinct(), "path").groupBy("row_id").agg(F.min_by("path", "at").alias("resolved"))
    return samples.select("row_id", "image_path").join(hit, "row_id", "left")
