"""Readers of benchmark files. Paths may name any file system Spark knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTION = "struct<id:string,text:string,answer:string,weakness_target:string>"
VARIANT = "struct<id:string,difficulty:string,prompt_delta:string,viewpoint_motion_target_delta:double>"
#: One annotation record; the target is a number or text, so it is read as a variant.
SAMPLE = (
    "task_id string, domain string, topology_type string, primary_topology string, sub_topology string, image_path string, prompt string, video_generation_prompt string, motion_type string, "
    "viewpoint_motion_target variant, difficulty_profile map<string,string>, constraint_annotations variant, task_category string, application_value string, axis_weights map<string,double>, "
    f"axis_rubric map<string,string>, failure_target string, industrial_logic_questions array<{QUESTION}>, ika_questions array<{QUESTION}>, questions array<{QUESTION}>, vfa_target variant, sensitivity_variants array<{VARIANT}>"
)
#: A per-sample result as a runner writes it; old names are kept beside new ones.
RESULT = (
    "task_id string, domain string, task_category string, motion_type string, skipped boolean, skip_reason string, viewpoint_motion double, vfa double, viewpoint_motion_target_degrees double, "
    "vfa_target_degrees double, viewpoint_motion_score double, vfa_score double, industrial_constraint_details struct<violations:array<string>,invariants_checked:array<string>>, "
    "ic_details struct<violations:array<string>,invariants_checked:array<string>>, scored struct<weighted_score:double,axis_scores:map<string,double>,num_axes:int,rif:double,rif_gated:double,viewpoint_motion_score:double,vfa_score:double>, weighted_score double, axis_scores map<string,double>"
)
AGGREGATE = "overall double, relax_score double, strict_pass_rate double, gated_score double, viewpoint_motion_tier string, rif double, rif_gated double, num_samples_total bigint, num_samples_completed bigint, axis_scores map<string,double>"
#: Files in a results folder that are not results.
REPORTS = ("eval_report.json", "calibration_report.json", "per_sample.json", "aggregate.json", "report.json", "leaderboard.json")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Annotation records of JSON files that hold {"samples": [...]} or a bare list.

    A field that is absent and one that is null read alike; old names of the question list and of the target
    stand in for missing new ones. The order of records is kept in ``seq``: the file's record, then the place in it.
    """
    raw = spark.read.schema(f"{SAMPLE}, samples array<struct<{_fields(SAMPLE)}>>").option("multiLine", True).json(path)
    own = F.struct(*(F.col(f) for f in _names(SAMPLE)))
    rows = raw.select(F.posexplode(F.coalesce("samples", F.array(own))).alias("at", "s"), F.monotonically_increasing_id().alias("record"))
    rows = rows.select("s.*", F.struct("record", "at").alias("seq"))
    rows = rows.withColumns({"industrial_logic_questions": F.coalesce("industrial_logic_questions", "ika_questions", "questions"), "viewpoint_motion_target": F.coalesce("viewpoint_motion_target", "vfa_target")})
    return rows.drop("ika_questions", "questions", "vfa_target")


def _names(ddl: str) -> list[str]:
    return T._parse_datatype_string(ddl).fieldNames()


def _fields(ddl: str) -> str:
    return T._parse_datatype_string(ddl).simpleString()[len("struct<") : -1]


def keyed(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One record a task_id: the last wins."""
    w = Window.partitionBy("task_id").orderBy(F.desc(order))
    return rows.where(F.col("task_id").isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def target_degrees(target: Column) -> Column:
    """The number in a variant target; named targets are left to ``axes.parse_target``."""
    return F.coalesce(F.try_variant_get(target, "$", "double"), F.regexp_extract(F.try_variant_get(target, "$", "string"), r"_(\d+(?:\.\d+)?)deg$", 1).try_cast("double"))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, qid, answer) of a JSON map "task:question" -> answer; unreadable files give no rows."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "answer"))
    return rows.select(F.substring_index("key", ":", 1).alias("task_id"), F.expr("substring(key, instr(key, ':') + 1)").alias("qid"), "answer")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Per-sample results of a folder, one JSON object a file; reports and broken files are left out.

    New names win over old ones, and scores are taken from ``scored`` or from the top level.
    """
    raw = spark.read.schema(f"{RESULT}, _corrupt_record string").option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path)
    raw = raw.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path")).where(~F.col("file").isin(*REPORTS) & F.col("_corrupt_record").isNull())
    either = lambda a, b: F.coalesce(a, b).alias(a)
    return raw.select(
        F.coalesce("task_id", F.regexp_replace("file", r"\.json$", "")).alias("task_id"),
        F.element_at(F.split("path", "/"), -2).alias("model"),
        "domain",
        "task_category",
        "motion_type",
        F.coalesce("skipped", F.lit(False)).alias("skipped"),
        "skip_reason",
        either("viewpoint_motion", "vfa"),
        either("viewpoint_motion_target_degrees", "vfa_target_degrees"),
        either("viewpoint_motion_score", "vfa_score"),
        either("industrial_constraint_details", "ic_details"),
        F.coalesce("scored.weighted_score", "weighted_score").alias("weighted_score"),
        F.coalesce("scored.axis_scores", "axis_scores").alias("axis_scores"),
        F.coalesce(
            "scored.viewpoint_motion_score", "viewpoint_motion_score", "scored.vfa_score", "vfa_score", *(F.try_element_at("scored.axis_scores", F.lit(k)) for k in ("viewpoint_motion_fidelity", "vfa"))
        ).alias("gate_score"),
    )


def aggregates(spark: SparkSession, path: str) -> DataFrame:
    """One row a model from <path>/*/aggregate.json, with defaults; broken files are left out."""
    raw = spark.read.schema(f"{AGGREGATE}, _corrupt_record string").option("multiLine", True).json(f"{path}/*/aggregate.json")
    rows = raw.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("model")).where(F.col("_corrupt_record").isNull())
    return rows.select("model", F.coalesce("overall", F.lit(0.0)).alias("overall"), F.coalesce("viewpoint_motion_tier", F.lit("unknown")).alias("viewpoint_motion_tier"), "relax_score", "strict_pass_rate", "gated_score", "rif", "rif_gated", "num_samples_total", "num_samples_completed", "axis_scores")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, words) of the images below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    last = F.array_join(F.slice(F.split(F.regexp_replace("path", r"\.[^.]*$", ""), "/"), -3, 3), " ")
    words = F.array_distinct(F.filter(F.split(F.lower(last), r"[^a-z0-9]+"), lambda w: F.length(w) >= 3))
    return files.where(F.lower("path").rlike(r"\.(jpg|jpeg|png|webp)$")).select("path", F.col("length").alias("bytes"), words.alias("words"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest, all columns as text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Decoded frames kept as Parquet: video, frame, height, width, channels, pixels."""
    return spark.read.parquet(path).select("video", "frame", "height", "width", "channels", "pixels")


def frame_counts(frames_: DataFrame, reported: DataFrame, tolerance: float = 0.9) -> DataFrame:
    """Frames decoded of each video against what its container reported."""
    have = frames_.groupBy("video").agg((F.max("frame") + 1).alias("actual"))
    return reported.join(have, "video", "left").withColumn("actual", F.coalesce("actual", F.lit(0))).withColumn("short", F.col("actual") < F.col("reported") * tolerance)
