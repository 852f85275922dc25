"""Queries of the reference operators over the whole tables.

Results, samples and models are the benchmark's own tables; what they lack (measured motion,
answers, frame series, vectors) is derived from the star schema by arithmetic both engines share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom import registry as R
from benchloom.functions import axes as A
from benchloom.functions import text as T
from benchloom.kernels import apply_kernel, kernels
from benchloom.kernels import registry as KR
from benchloom.operators import aggregate as G
from benchloom.operators import clips as C
from benchloom.operators import dataops as D
from benchloom.operators import documents as O
from benchloom.operators import measures as M
from benchloom.operators import qa as Q
from benchloom.operators import scoring as S
from benchloom.operators import series as X
from benchloom.operators import taxonomy
from benchloom.session import checkpoint_dir, table
from benchloom.streaming import incremental

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (ties upwards), counts as bigint, for comparison between engines."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(F.col(c) + 1e-9, digits) if digits > 4 else F.round(c, digits)).alias(c) if kinds[c] == "double" else F.col(c).cast("bigint").alias(c) if kinds[c] == "int" else F.col(c) for c in df.columns))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return S.scored(table(spark, d, "sample_results"))


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """Motion measured and asked for, out of orders."""
    o = table(spark, d, "orders")
    rows = o.select("o_orderkey", (F.col("o_orderkey") % 13 == 0).alias("skipped"), (F.col("o_orderkey") % 22 == 0).alias("uncalculable"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_custkey") % 900) / 10.0).alias("motion"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 120).cast("double")).alias("target"))
    return rows.withColumn("fidelity", A.motion_fidelity(F.col("motion"), F.col("target")))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """One value a frame: the events of a user in order of time."""
    e = table(spark, d, "events").select(F.col("user_id").alias("video"), "ts", "event_id", "value", (F.col("event_id") % 5).alias("n"))
    return X.number_frames(e, "ts", "event_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("video"), "vec_id", F.col("embedding").alias("vector"))
    return X.number_frames(e, "vec_id")


def _answers(asked: DataFrame) -> DataFrame:
    """An answer to every question but each seventh, by arithmetic on its place."""
    k = (F.col("row_id") * 7 + F.col("pos") * 3) % 5
    said = F.element_at(F.array(F.lit("Yes."), F.lit("no"), F.lit("  YES it remains intact"), F.lit("not sure"), F.lit("")), (k + 1).cast("int"))
    reasons = F.when(F.col("row_id") % 3 == 0, "No cracking: the frame is structurally sound.").otherwise("")
    return asked.where((F.col("row_id") + F.col("pos")) % 7 != 0).select("row_id", "pos", said.alias("answer"), reasons.alias("reasoning"))


def _response(c: Column) -> Column:
    """A judge's text, by arithmetic on an id."""
    k = (c % 8).cast("int")
    n = (c % 137).cast("string")
    return F.element_at(
        F.array(F.concat(n, F.lit("\nminor issue")), F.concat(n, F.lit("% sure")), F.concat(F.lit("score "), n, F.lit(" then 70.")), F.lit(""), F.lit("  "), F.concat(F.lit("Fine.\nI say "), n, F.lit(";")), F.lit("no score"), F.concat(F.lit("("), n, F.lit(") 12"))),
        k + 1,
    )


@query
def leaderboard(spark, d):
    """Flagship: metrics of every model, ranked."""
    out = G.leaderboard(G.model_metrics(_scored(spark, d), table(spark, d, "models")))
    return rounded(out.select("rank", "model_id", "model_name", "overall", "relax_score", "strict_pass_rate", "gated_score", *S.SHORT, "motion_tier", "num_samples_completed"))


@query
def leaderboard_markdown(spark, d):
    ranked = G.leaderboard(G.model_metrics(_scored(spark, d), table(spark, d, "models")))
    return rounded(G.leaderboard_markdown(ranked.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("overall", "relax_score", *S.SHORT)})))


@query
def sample_scores(spark, d):
    return rounded(_scored(spark, d).select("result_id", *S.SHORT, "motion", "constraint", "num_axes", "weighted_score", "rif", "rif_gated", "strict", "gate"))


@query
def axis_long_canonical(spark, d):
    return rounded(S.alias_long(table(spark, d, "sample_results")))


@query
def axis_floors(spark, d):
    rows = S.alias_long(table(spark, d, "sample_results"))
    return rounded(rows.select("result_id", "axis", F.greatest("score", A.floor_of(F.col("axis"))).alias("score")))


@query
def axis_floor_nan(spark, d):
    """Floors over raw scores: NaN and minus infinity count as the floor, plus infinity is null."""
    floored = lambda axis: A.sanitize(A.floored(axis, F.col(f"{axis}_score")))
    return rounded(table(spark, d, "sample_results").select("result_id", floored(R.GEOMETRY).alias("geometry"), floored(R.LOGIC).alias("logic")))


@query
def sanitize_nan(spark, d):
    rows = table(spark, d, "sample_results")
    return rounded(rows.select("result_id", *(A.sanitize(F.col(c)).alias(s) for c, s in zip(S.COLUMNS, S.SHORT)), A.sanitize(F.col("scored.weighted_score")).alias("weighted")))


@query
def target_parse(spark, d):
    rows = table(spark, d, "samples")
    return rounded(rows.select("row_id", A.parse_target(F.col("viewpoint_motion_target")).alias("target")))


@query
def motion_fidelity(spark, d):
    rows = _clips(spark, d)
    return rounded(rows.select("o_orderkey", F.round("fidelity", 3).alias("fidelity"), A.motion_tier(F.col("motion")).alias("tier"), A.crane_angle(F.col("motion"), F.lit(1080.0)).alias("crane"), A.is_static(F.col("motion"), F.col("o_orderkey") % 2 == 0).alias("static")))


@query
def motion_diagnostics(spark, d):
    return rounded(G.motion_diagnostics(_clips(spark, d)))


@query
def model_aggregate(spark, d):
    return rounded(G.model_metrics(_scored(spark, d), table(spark, d, "models")))


@query
def breakdown_sets(spark, d):
    return rounded(G.breakdowns(_scored(spark, d)))


@query
def low_fidelity_domains(spark, d):
    return G.low_fidelity(G.breakdowns(_scored(spark, d)))


@query
def angle_gates(spark, d):
    """Scores of results that also have the motion itself, in degrees: gates and tiers go by it, not by its fidelity."""
    angle = F.when(F.col("result_id") % 5 != 0, (F.col("result_id") % 700) / 10.0)
    rows = S.scored(table(spark, d, "sample_results").withColumn("viewpoint_motion", angle))
    return rounded(G.model_metrics(rows, table(spark, d, "models")).select("model_id", "motion_tier", "rif", "rif_gated", "rif_note", "gated_score"), 4)


@query
def rif_by_model(spark, d):
    """RIF of samples on average and as product, beside the RIF of the means."""
    rows = S.completed(_scored(spark, d)).groupBy("model_id").agg(F.avg("rif").alias("mean_rif"), F.count("rif").alias("with_rif"), F.count("rif_gated").alias("with_gated"), F.avg("rif_gated").alias("mean_gated"))
    return rounded(rows)


@query
def axis_statistics(spark, d):
    return rounded(G.axis_statistics(_scored(spark, d)))


@query
def weakest_axes(spark, d):
    return rounded(G.weakest_axes(G.axis_statistics(_scored(spark, d))))


@query
def group_scores(spark, d):
    return rounded(G.group_scores(_scored(spark, d), table(spark, d, "samples")))


@query
def constraint_counts(spark, d):
    return rounded(G.constraint_counts(_scored(spark, d)))


@query
def constraint_summary(spark, d):
    return rounded(G.constraint_summary(_scored(spark, d)))


@query
def ability_failures(spark, d):
    return rounded(G.ability_failures(_scored(spark, d)))


@query
def worst_samples(spark, d):
    rows = _scored(spark, d).withColumn("weighted_score", F.round(F.col("weighted_score") + 1e-9, 6))
    return rounded(G.worst_samples(rows))


@query
def worst_per_axis(spark, d):
    rows = _scored(spark, d).withColumns({s: F.round(F.col(s) + 1e-9, 6) for s in S.SHORT})
    return rounded(G.worst_per_axis(rows))


@query
def weakest_axis_per_sample(spark, d):
    rows = _scored(spark, d).withColumns({s: F.round(F.col(s) + 1e-9, 6) for s in S.SHORT})
    return rounded(G.weakest_axis(S.completed(rows)))


@query
def difficulty_calibration(spark, d):
    return rounded(G.calibration(_scored(spark, d), table(spark, d, "samples")))


@query
def axis_calibration(spark, d):
    return rounded(G.calibration(_scored(spark, d), table(spark, d, "samples"), "geometry"))


@query
def checker_dispatch(spark, d):
    """Checkers by domain and topology as declared, else by category."""
    rows = table(spark, d, "samples").select("row_id", A.tidy(F.col("domain")).alias("domain"), F.col("topology_type").alias("topology"), A.canonical_task(F.col("task_category")).alias("task_category"))
    return S.dispatch(rows).select("row_id", F.array_join(F.transform("checkers", lambda c: F.concat(c["checker"], F.lit(":"), c["argument"])), ",").alias("checkers"))


@query
def infer_task_category(spark, d):
    return taxonomy.infer_task_category(table(spark, d, "samples")).select("row_id", "inferred_task")


@query
def effective_weights(spark, d):
    return rounded(taxonomy.effective_weights(table(spark, d, "samples")))


@query
def question_scores(spark, d):
    asked = Q.questions(table(spark, d, "samples"))
    return rounded(Q.question_scores(Q.evaluate(asked, _answers(asked))))


@query
def weakness_accuracy(spark, d):
    asked = Q.questions(table(spark, d, "samples"))
    return rounded(Q.weakness_accuracy(Q.evaluate(asked, _answers(asked))))


@query
def answer_join(spark, d):
    asked = Q.questions(table(spark, d, "samples"))
    return rounded(Q.evaluate(asked, _answers(asked)).select("row_id", "pos", "qid", "expected", "answer", "outcome"))


@query
def positional_join(spark, d):
    """Lines of a judge's response to the questions of a sample, by position."""
    samples = table(spark, d, "samples")
    k = F.col("row_id") % 4
    line = F.when(k == 0, '1. {"answer": "Yes", "chain_of_thought": "ok"}\n2. no').when(k == 1, '1. No\n\n3. {"answer": "n"}').when(k == 2, "Yes it is").otherwise('{"answer": 5}\n2. maybe')
    return rounded(Q.answers_of_lines(Q.questions(samples), samples.select("row_id", line.alias("raw_response"))).select("row_id", "pos", "answer"))


@query
def score_parse(spark, d):
    text = _response(F.col("event_id"))
    rows = table(spark, d, "events").select("event_id", text.alias("t"))
    return rounded(rows.select("event_id", T.parse_score_plain(F.col("t")).alias("plain"), T.parse_score_marks(F.col("t")).alias("marks"), T.parse_score_lines(F.col("t")).alias("lines"), T.verdict(F.col("t")).alias("verdict")))


@query
def score_sources(spark, d):
    """A judge's score before a measured one, with what it came from, and the blends of both."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("judged"), F.when(F.col("event_id") % 4 != 0, F.col("value") / 2).alias("measured"))
    rows = Q.first_source(e, judged="judged", measured="measured")
    return rounded(rows.select("event_id", "source", "score", A.temporal_blend(F.col("measured"), F.col("judged")).alias("temporal"), A.fidelity_blend(F.col("measured"), F.lit(0.5), F.col("judged")).alias("fidelity"), A.kinematic_blend(F.col("judged"), F.col("measured")).alias("kinematic")))


@query
def schema_violations(spark, d):
    return D.violations(table(spark, d, "samples"))


@query
def motion_audit(spark, d):
    rows = D.audit(table(spark, d, "samples"))
    return rows.select("row_id", "motion", F.array_join("issues", ",").alias("issues"), "severity")


@query
def issue_counts(spark, d):
    return rounded(D.issue_counts(D.audit(table(spark, d, "samples"))))


def _sectioned(spark: SparkSession, d: str) -> DataFrame:
    """Samples whose prompts are put under the headings that the audit reads."""
    heading = F.regexp_replace("prompt", r"(Motion requirement|Camera|Viewpoint): ", "Motion requirement / viewpoint motion fidelity: ")
    return table(spark, d, "samples").withColumn("prompt", F.concat(F.regexp_replace(heading, r"; (?=[A-Z])", ". "), F.lit(" No zoom.")))


@query
def motion_audit_sections(spark, d):
    rows = D.audit(_sectioned(spark, d))
    return rows.select("row_id", "motion", F.md5("clause").alias("clause"), F.md5("subject").alias("subject"), F.array_join("issues", ",").alias("issues"), "severity")


@query
def issue_index(spark, d):
    return D.issue_index(D.audit(_sectioned(spark, d)))


@query
def review_order(spark, d):
    return rounded(D.review_order(D.audit(_sectioned(spark, d))).select("row_id", "severity", "rank"))


@query
def prompt_rules(spark, d):
    """Closing rule, units completed, visibility, and the names cut out of paths and prompts."""
    rows = table(spark, d, "samples")
    motion = A.tidy(F.col("motion_type"))
    return rows.select("row_id", F.md5(T.no_zoom(F.col("video_generation_prompt"))).alias("closed"), F.md5(T.complete_unit(F.col("prompt"), motion)).alias("completed"), T.stem(F.col("image_path")).alias("stem"), T.visibility(motion, T.motion_clause(F.col("prompt"))).alias("visibility"))


@query
def variant_flags(spark, d):
    return D.variant_flags(table(spark, d, "samples")).groupBy("flag").agg(F.count("*").alias("n"))


@query
def prompt_export(spark, d):
    return D.export_rows(table(spark, d, "samples"))


@query
def prompt_headers(spark, d):
    return D.export_headers(table(spark, d, "samples"))


@query
def reuse_counts(spark, d):
    return G.image_reuse(table(spark, d, "samples"))


@query
def dedupe_keep_first(spark, d):
    return rounded(D.keep_first(table(spark, d, "documents"), "text", "doc_id"))


def _tokens(*cols: str) -> Column:
    return T.tokens(F.concat_ws(" ", *cols))


@query
def token_candidates(spark, d):
    """Assets whose names share most words with those of parts: an equi-join on tokens."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("query"), _tokens("p_name", "p_type").alias("words"), (F.col("p_partkey") % 400 + 1).alias("current"))
    assets = table(spark, d, "assets").select(F.col("asset_id").alias("item"), _tokens("asset_name", "domain").alias("words"))
    return rounded(D.candidates(parts, assets))


def _plan(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "samples")
    return D.sourcing_plan(samples, samples.where(F.col("row_id") % 3 != 0).select("image_path"))


@query
def sourcing_plan(spark, d):
    return rounded(_plan(spark, d))


@query
def sourcing_review(spark, d):
    return rounded(D.to_review(_plan(spark, d)).select("task_id", "current_image_reuse_count", "image_exists"))


@query
def sourcing_lines(spark, d):
    got = O.sourcing_lines(_plan(spark, d))
    return rounded(got.select("task_id", "line_no", F.md5("line").alias("line")))


@query
def prompt_lines(spark, d):
    got = O.prompt_lines(table(spark, d, "samples"))
    return rounded(got.select("domain", "task_category", "task_id", "line_no", F.md5("line").alias("line")))


@query
def audit_lines(spark, d):
    samples = _sectioned(spark, d)
    got = O.audit_lines(D.audit(samples), samples)
    return rounded(got.select("rank", "task_id", "row_id", "line_no", F.md5("line").alias("line")))


@query
def audit_document(spark, d):
    """Counts of the audit, read back out of its JSON document (the time it bears is left out)."""
    samples = _sectioned(spark, d)
    doc = F.from_json("document", "total_samples bigint, flagged_count bigint, static_excluded_from_verb_check bigint, severity_counts struct<high:bigint,medium:bigint,low:bigint>, issue_counts map<string,struct<n:bigint>>")
    rows = O.audit_document(D.audit(samples), samples).select(doc.alias("x")).select("x.*")
    return rows.select("total_samples", "flagged_count", F.col("static_excluded_from_verb_check").alias("static"), "severity_counts.high", "severity_counts.medium", "severity_counts.low", F.array_join(F.array_sort(F.transform(F.map_entries("issue_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["n"].cast("string")))), ",").alias("issues"))


@query
def aggregate_documents(spark, d):
    """What the aggregate document of each model holds, read back out of its JSON."""
    scored = _scored(spark, d)
    docs = O.aggregate_documents(G.model_metrics(scored, table(spark, d, "models")), G.breakdowns(scored))
    part = "struct<overall:double,num_samples:bigint>"
    doc = F.from_json("document", f"overall double, relax_score double, num_samples_completed bigint, viewpoint_motion_tier string, axis_scores map<string,double>, domain_breakdown map<string,{part}>, task_breakdown map<string,{part}>, low_fidelity_summary struct<domains_physical_low:array<string>,domains_geometric_low:array<string>>")
    rows = docs.select("model_name", doc.alias("x")).select("model_name", "x.*")
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda s, v: s + v["num_samples"])
    return rows.select("model_name", F.round("overall", 4).alias("overall"), "num_samples_completed", F.col("viewpoint_motion_tier").alias("tier"), F.size(F.coalesce("axis_scores", F.create_map().cast("map<string,double>"))).cast("bigint").alias("axes"), F.coalesce(F.size("domain_breakdown"), F.lit(0)).cast("bigint").alias("domains"), F.coalesce(total("domain_breakdown"), F.lit(0)).alias("in_domains"), F.coalesce(total("task_breakdown"), F.lit(0)).alias("in_tasks"), F.coalesce(F.array_join("low_fidelity_summary.domains_physical_low", ","), F.lit("")).alias("physics_low"))


@query
def report_document(spark, d):
    """Figures of the diagnostic report of the model with most results, read back out of its JSON."""
    results = table(spark, d, "sample_results")
    top = results.groupBy("model_id").count().orderBy(F.desc("count"), "model_id").limit(1).select("model_id")
    scored = S.scored(results.join(F.broadcast(top), "model_id", "left_semi"))
    stat = "struct<mean:double,median:double,n:bigint>"
    doc = F.from_json("document", f"model string, summary struct<num_samples_total:bigint,num_samples_completed:bigint>, axis_statistics map<string,{stat}>, weakest_axes array<struct<axis:string>>, worst_samples array<struct<result_id:bigint>>, by_domain map<string,struct<n:bigint>>")
    rows = O.report_document(scored, table(spark, d, "samples"), "top").select(doc.alias("x")).select("x.*")
    stats = rows.select("summary.num_samples_total", "summary.num_samples_completed", F.size("by_domain").cast("bigint").alias("domains"), F.col("weakest_axes")[0]["axis"].alias("weakest"), F.col("worst_samples")[0]["result_id"].alias("worst"), F.explode("axis_statistics").alias("axis", "s"))
    return stats.select("num_samples_total", "num_samples_completed", "domains", "weakest", "worst", "axis", F.round("s.mean", 3).alias("mean"), F.round("s.median", 3).alias("median"), F.col("s.n").alias("n"))


@query
def leaderboard_document(spark, d):
    ranked = G.leaderboard(G.model_metrics(_scored(spark, d), table(spark, d, "models")))
    doc = F.from_json("document", "models array<struct<rank:bigint,model:string,viewpoint_motion_tier:string,num_samples_completed:bigint>>, num_models bigint")
    return O.leaderboard_document(ranked).select(doc.alias("x")).select(F.col("x.num_models").alias("num_models"), F.inline("x.models"))


@query
def calibration_document(spark, d):
    got = O.calibration_document(G.calibration(_scored(spark, d), table(spark, d, "samples")), "all")
    doc = F.from_json("document", "buckets map<string,struct<mean_score:double,n_samples:bigint,above_target:boolean>>, flags array<string>")
    return got.select(doc.alias("x"), F.size(F.split("console", "\n")).cast("bigint").alias("console_lines")).select(F.size("x.flags").cast("bigint").alias("flags"), "console_lines", F.explode("x.buckets").alias("bucket", "b")).select("flags", "console_lines", "bucket", "b.mean_score", "b.n_samples", "b.above_target")


@query
def skip_reasons(spark, d):
    """Tasks whose video is missing, empty or failed, by arithmetic on the results."""
    videos = table(spark, d, "sample_results").where(F.col("task_id").isNotNull()).groupBy("task_id").agg((F.min("result_id") % 4).alias("frames"), (F.max("result_id") % 9 == 0).alias("failed"))
    return O.skipped(table(spark, d, "samples"), videos)


@query
def manifest_upsert(spark, d):
    p = table(spark, d, "part")
    manifest = p.select(F.concat(F.lit("images/"), "p_partkey", F.lit(".jpg")).alias("local_path"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 5 == 0, "kept").alias("curation_status"))
    curated = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("images/"), "p_partkey", F.lit(".jpg")).alias("local_path"), (F.col("p_size") * 100).alias("curated_width"), F.lit(700).alias("curated_height"), F.lit(None).alias("curated_bytes"), A.curation_status(F.col("p_size") * 100, F.lit(900)).alias("curation_status"))
    return O.upsert_manifest(manifest, curated)


@query
def completed_counts(spark, d):
    return rounded(O.completed_counts(_scored(spark, d)))


@query
def task_profile_rest(spark, d):
    """What a sample's category is good for and what its image must show, by its inferred category."""
    rows = taxonomy.infer_task_category(table(spark, d, "samples"))
    value = F.coalesce(F.nullif("application_value", F.lit("")), F.try_element_at(R.literal_map(R.TASK_VALUES), F.col("inferred_task")))
    return rows.select("row_id", F.md5(value).alias("value"), F.md5(F.try_element_at(R.literal_map(R.IMAGE_REQUIREMENTS), F.col("inferred_task"))).alias("requirement"), F.try_element_at(R.literal_map(R.TASK_GATES), F.col("inferred_task")).alias("gate"))


@query
def resolve_images(spark, d):
    samples = table(spark, d, "samples")
    hq = F.concat(F.regexp_replace(F.replace("image_path", F.lit("/images/"), F.lit("/images_hq/")), r"\.[^.]*$", ""), F.lit(".png"))
    present = samples.select(F.when(F.col("row_id") % 2 == 0, hq).otherwise(F.col("image_path")).alias("image_path")).where("image_path is not null")
    return D.resolve_images(samples, present)


@query
def image_sizes(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 100).alias("w"), (F.col("p_partkey") % 40 * 90 + 200).alias("h"))
    w, h = A.image_target_size(F.col("w"), F.col("h"))
    return rounded(rows.select("p_partkey", w.alias("width"), h.alias("height"), A.curation_status(F.col("w"), F.col("h")).alias("status")))


@query
def integrity_counts(spark, d):
    return rounded(D.integrity(table(spark, d, "samples").select("task_id"), table(spark, d, "sample_results"), "task_id"))


@query
def missing_assets(spark, d):
    return D.missing(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query
def keyed_samples(spark, d):
    return D.latest(table(spark, d, "samples")).select("task_id", "row_id")


@query
def judge_context(spark, d):
    rows = table(spark, d, "samples")
    hard = F.from_json(F.get_json_object("constraint_annotations", "$.hard_constraints"), "array<string>")
    lines = T.context_lines({"domain": F.col("domain"), "topology": F.col("topology_type"), "motion": F.col("motion_type")}, hard)
    return rows.select("row_id", F.md5(lines).alias("context"), F.md5(T.question_lines(F.col("industrial_logic_questions"))).alias("questions"))


@query
def flow_kinematic(spark, d):
    return rounded(X.kinematic_score(_frames(spark, d)))


@query
def count_invariant(spark, d):
    return rounded(X.count_invariant(_frames(spark, d)), 5)


@query
def merge_fraction(spark, d):
    return rounded(X.merge_fraction(_frames(spark, d), 3))


@query
def coupling_cv(spark, d):
    return rounded(X.variation_score(_frames(spark, d)))


@query
def direction_consistency(spark, d):
    return rounded(X.direction(_frames(spark, d)))


@query
def moving_average(spark, d):
    return rounded(X.moving_average(_frames(spark, d)).select("video", "frame", "smooth"))


@query
def peak_gap_merge(spark, d):
    rows = X.merge_gaps(_frames(spark, d).where("value > 20"), "frame", 5.0)
    return rounded(rows.select("video", "groups", F.array_join(F.transform("kept", lambda x: x.cast("int").cast("string")), ",").alias("kept")))


@query
def anchor_pair(spark, d):
    return rounded(X.anchors(_frames(spark, d)))


@query
def adjacent_pairs(spark, d):
    return rounded(X.adjacent(_frames(spark, d)).select("video", "frame", "previous", "value"))


@query
def stride_sample(spark, d):
    return rounded(X.stride_sample(_frames(spark, d)).select("video", "frame"))


@query
def even_sample(spark, d):
    return rounded(X.even_sample(_frames(spark, d)).select("video", "frame"))


@query
def thirds_sample(spark, d):
    return rounded(X.thirds_sample(_frames(spark, d)).select("video", "frame"))


@query
def first_middle_last(spark, d):
    return rounded(X.first_middle_last(_frames(spark, d)).select("video", "frame"))


@query
def adjacent_cosine(spark, d):
    return rounded(X.adjacent_cosine(_vectors(spark, d)), 4)


@query
def nn_chamfer(spark, d):
    return rounded(X.chamfer(_vectors(spark, d)), 4)


@query
def ratio_match(spark, d):
    return rounded(X.ratio_matches(_vectors(spark, d)), 4)


@query
def pairwise_dist(spark, d):
    return rounded(X.link_lengths(_vectors(spark, d)), 4)


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """The first 60 numbers of a vector as a frame of 4 x 5 pixels in three channels, 0..255 around 128."""
    v = _vectors(spark, d)
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 400 + 128.5).cast("int")))
    data = F.unhex(F.array_join(F.transform(F.slice("vector", 1, 60), lambda x: F.lpad(F.hex(byte(x.cast("double"))), 2, "0")), ""))
    return v.select(F.col("video").cast("bigint").alias("video"), F.col("frame").cast("bigint").alias("frame"), F.lit(4).alias("height"), F.lit(5).alias("width"), F.lit(3).alias("channels"), data.alias("pixels"))


#: Size to which the small frames are brought; kernels that SQL can express are compared on the frames as they are.
SMALL = (40, 56)
AS_THEY_ARE = ("dark_background", "bilateral_symmetry", "roi_correlation", "histogram_correlation")


def _kernel(name: str):
    def run(spark, d):
        got = apply_kernel(_pixels(spark, d), name, None if name in AS_THEY_ARE else SMALL)
        if dict(got.dtypes)["value"] == "double":
            return rounded(got)
        return got.withColumn("value", F.transform("value", lambda x: F.round(x + 1e-9, 6)))

    run.__name__ = f"kernel_{name}"
    return query(run)


for _name in kernels():
    _kernel(_name)


@query
def camera_motion(spark, d):
    """Motion of each clip's camera; every third clip is a crane."""
    clips = _pixels(spark, d)
    motions = clips.select("video").distinct().withColumn("motion", F.when(F.col("video") % 3 == 0, "crane").otherwise("orbit"))
    return rounded(KR.camera_motion(clips, motions, SMALL))


@query
def static_camera(spark, d):
    return rounded(C.static_camera(KR.static_flows(_pixels(spark, d), SMALL)))


@query
def clip_constraints(spark, d):
    """All checks that a clip calls for, by its domain and topology or by its category."""
    frames = _pixels(spark, d)
    k = F.col("video").cast("int")
    pick = lambda *names: F.element_at(F.array(*(F.lit(n) for n in names)), k % len(names) + 1)
    clips = frames.select("video").distinct().select("video", pick("robotics", "mining", "energy_renewable", "manufacturing", "electronics", "nowhere").alias("domain"), pick("kinematic", "kinematic", "kinematic", "kinematic", "lattice").alias("topology"), pick("topology_mutation_and_failure", "none").alias("task_category"))
    got = C.constraints(frames, clips, SMALL)
    return rounded(got.select("video", "constraint", F.size("violations").alias("violations"), F.array_join("invariants", ",").alias("invariants")))


@query
def clip_temporal(spark, d):
    return rounded(C.temporal(_pixels(spark, d), SMALL))


@query
def clip_fidelity(spark, d):
    """Clips against a reference image each: the first frame of the clip with the next number."""
    frames = _pixels(spark, d)
    images = frames.where("frame = 0").withColumn("video", (F.col("video") + 9) % 10)
    return rounded(C.fidelity(frames, images, SMALL))


@query
def clip_geometry(spark, d):
    """The geometry score that each clip's topology calls for."""
    frames = _pixels(spark, d)
    k = F.col("video").cast("int")
    pick = lambda *names: F.element_at(F.array(*(F.lit(n) for n in names)), k % len(names) + 1)
    clips = frames.select("video").distinct().select("video", pick("2d_planar", "3d_spatial", "aerodynamic", "articulated", "rotational", "cable_hose", "").alias("sub"), pick("kinematic", "lattice", "unknown").alias("topology"))
    return rounded(C.geometry(frames, clips, SMALL))


@query
def unknown_fields(spark, d):
    rows = table(spark, d, "raw_results").select(F.col("line_id").alias("record"), F.col("payload").alias("json"))
    return D.unknown_fields(rows, ("task_id", "domain", "task_category", "skipped"))


def _series(spark: SparkSession, d: str, value: Column) -> DataFrame:
    return _frames(spark, d).select("video", "frame", value.alias("value"))


@query
def count_check(spark, d):
    got = C.count_check(_series(spark, d, F.col("n").cast("double")), 0.9)
    return rounded(got.select("video", "score", "stable", "weight", F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts")))


@query
def count_aggregate(spark, d):
    """All count checks of a domain's clips as one score, the harder elements weighing more."""
    counts = _series(spark, d, F.col("n").cast("double"))
    checks = [C.count_check(counts.where(F.col("video") % 4 == i), weight) for i, (_, weight) in enumerate(C.ELEMENTS.values())]
    rows = checks[0]
    for more in checks[1:]:
        rows = rows.unionByName(more)
    return rounded(X.weighted_count_score(rows), 4)


@query
def merge_check(spark, d):
    return rounded(C.merge_check(_series(spark, d, F.col("n").cast("double")), 3))


@query
def trace_check(spark, d):
    return rounded(C.trace_check(_series(spark, d, F.when(F.col("video") % 4 == 0, 0.0).when(F.col("video") % 4 == 1, F.col("n").cast("double")).otherwise(20.0 + (F.col("n") * (F.col("video") % 7)).cast("double")))))


@query
def jacket_check(spark, d):
    rows = _vectors(spark, d).select("video", "frame", F.transform(F.slice("vector", F.lit(1), F.lit(2) + (F.col("frame") % 3) * 2), lambda x: x.cast("double")).alias("value"))
    return rounded(C.jacket_check(rows), 4)


@query
def turbine_check(spark, d):
    return rounded(C.turbine_check(_series(spark, d, F.when(F.col("n") != 2, F.col("value") / 100.0))), 4)


@query
def scissor_check(spark, d):
    k = F.col("video") % 5
    angle = F.when((k == 0) & (F.col("frame") > 0), None).when(k == 1, F.col("frame") * 0.1).when(k == 2, F.col("frame") * 0.1 + (F.col("frame") % 2) * 0.008).when(k == 3, 1.0).otherwise(F.col("value") / 30.0)
    return rounded(C.scissor_check(_series(spark, d, angle.cast("double"))), 4)


@query
def conveyor_check(spark, d):
    k = F.col("video") % 4
    flow = F.when(k == 0, 3.0 + F.col("n") * 0.1).when(k == 1, F.lit(-2.0) - F.col("n") * 0.5).when(k == 2, F.col("value") - 20.0).otherwise(F.when(F.col("frame") == 3, -1.0).otherwise(2.0))
    return rounded(C.conveyor_check(_series(spark, d, flow)), 4)


@query
def arm_check(spark, d):
    size = F.when(F.col("frame") % 4 == 3, F.lit(6)).when(F.col("frame") % 9 == 8, F.lit(1)).otherwise(F.lit(10))
    rows = _vectors(spark, d).select("video", "frame", F.transform(F.slice("vector", F.lit(1), size), lambda x: 20.0 + x.cast("double") * (F.col("video") % 3)).alias("value"))
    return rounded(C.arm_check(rows), 4)


@query
def chain_check(spark, d):
    rows = _vectors(spark, d).select("video", "frame", F.transform(F.slice("vector", 1, 5), lambda x, i: F.greatest(F.lit(0.0), x.cast("double") + F.when((i == 0) & (F.col("video") % 2 == 0), 0.5).otherwise(0.0))).alias("value"))
    return rounded(C.chain_check(rows))


def _kept(spark: SparkSession, stream: DataFrame, mode: str, *keys: str) -> DataFrame:
    """A stream read to its end into a table in the shared folder, and the state of that table."""
    place = f"{checkpoint_dir(spark)}/stream_{uuid.uuid4().hex}"
    incremental.start(stream, f"{place}/table", f"{place}/checkpoint", mode).awaitTermination()
    return incremental.current(spark, f"{place}/table", *keys)


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


@query
def event_windows(spark, d):
    """Windows of an event stream, late rows within the watermark included."""
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _kept(spark, incremental.windowed_events(events), "update", "window_start", "event_type")
    return rounded(rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query
def lattice_score(spark, d):
    e = table(spark, d, "events")
    a, b, m = F.col("event_id") % 60, F.col("user_id") % 70, F.col("event_id") % 37
    return rounded(e.select("event_id", M.lattice_score(a, b, m).alias("lattice"), M.surface_score(F.when(F.col("event_id") % 9 != 0, F.col("value") / 100.0)).alias("surface")))


@query
def geometry_route(spark, d):
    """The score a sample's topology calls for, as meant and as a faulty runner gives it."""
    rows = table(spark, d, "samples")
    value = lambda k: (F.col("row_id") * k % 101) / 100.0
    m = {"spectral": value(3), "lattice": value(5), "surface": value(7), "articulated": A.kinematic_blend(value(11), value(13)), "rotary": F.when(F.col("row_id") % 2 == 0, value(17)), "kinematic": value(11)}
    method, score = M.geometry_route(F.col("sub_topology"), F.col("primary_topology"), m)
    parity = M.geometry_route(F.col("sub_topology"), F.col("primary_topology"), m, strict_parity=True)[1]
    return rounded(rows.select("row_id", method.alias("method"), score.alias("score"), parity.alias("parity")))


@query
def constraint_mean(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("video"), F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 13) / 10.0).alias("score"))
    return rounded(M.constraint_mean(e), 4)


@query
def viewpoint_motion(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "crane").otherwise("orbit").alias("motion"), (F.col("o_orderkey") % 5).alias("frames"), ((F.col("o_custkey") % 40) / 10.0).alias("flow"))
    k = F.col("o_orderkey")
    some = lambda n, c: F.when(k % n != 0, c)
    shifts = [("affine", some(3, (k % 200).cast("double"))), ("phase", some(4, (k % 90).cast("double"))), ("flow", some(7, (k % 30).cast("double")))]
    turns = [("anchor_to_final", some(3, (k % 360 - 180).cast("double"))), ("anchor_to_second_last", some(5, (k % 50).cast("double")))]
    method, value = M.viewpoint_motion(F.col("motion"), F.col("frames"), F.col("flow"), k % 3 == 0, shifts, turns, F.lit(1080.0))
    return rounded(o.select("o_orderkey", method.alias("method"), value.alias("value")))


@query
def clip_scores(spark, d):
    """Temporal consistency and visual fidelity of clips with and without a judge."""
    e, k = table(spark, d, "events"), F.col("event_id")
    ssim, judged = (k % 100) / 100.0, F.when(k % 3 == 0, (k % 90).cast("double"))
    return rounded(e.select("event_id", F.round(M.temporal_consistency(ssim, k % 4, judged), 1).alias("temporal"), F.round(M.visual_fidelity(ssim, (k % 21 - 10) / 10.0, k % 4, judged), 1).alias("fidelity")), 4)


@query
def judge_prompts(spark, d):
    hard = F.from_json(F.get_json_object("constraint_annotations", "$.hard_constraints"), "array<string>")
    return table(spark, d, "samples").select("row_id", F.md5(M.judge_prompt(F.col("prompt"), hard)).alias("prompt"))


@query
def token_totals(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("judge"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"))
    return rounded(M.token_totals(e))


@query
def streaming_metrics(spark, d):
    """Model metrics kept up over a stream of the results, read to its end; one row a model and batch is written."""
    return rounded(_kept(spark, incremental.running_metrics(_stream(spark, d, "sample_results")), "update", "model_id"))


@query
def user_sessions(spark, d):
    """Sessions of each user with gaps of at most 30 minutes, over a stream."""
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _kept(spark, incremental.sessions(events), "complete")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("started"), "n")


@query
def sample_weights(spark, d):
    return S.sample_weights(table(spark, d, "samples"))


@query
def weighted_by_sample(spark, d):
    """Scores by the weights of the samples themselves."""
    rows = S.score_samples(S.measurements(table(spark, d, "sample_results")), S.sample_weights(table(spark, d, "samples")))
    return rounded(rows.select("result_id", "weighted_score"))
