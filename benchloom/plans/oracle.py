"""DuckDB counterparts of the queries, written on their own from the rules."""

from __future__ import annotations

from benchloom import registry as R

SHORT = ("logic", "geometry", "physics", "temporal", "reference")
RAW = dict(zip(SHORT, (f"{R.LOGIC}_score", f"{R.GEOMETRY}_score", f"{R.PHYSICS}_score", f"{R.TEMPORAL}_score", f"{R.REFERENCE}_score")))
AXIS = dict(zip(SHORT, R.AXES))


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) OR {c} = -1 THEN NULL ELSE {c} END"


def tidy(c: str) -> str:
    return f"nullif(regexp_replace(lower(trim({c})), '[\\s-]+', '_', 'g'), '')"


def mapped(c: str, values: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in values.items()) + f" ELSE {c} END"


def clamp(c: str, top: float = 100) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least({top}::DOUBLE, {c})) END"


def weight(short: str) -> str:
    i = SHORT.index(short)
    return "CASE task_category " + " ".join(f"WHEN {text(t)} THEN {w[i]}::DOUBLE" for t, w in R.TASK_WEIGHTS.items()) + f" ELSE {R.TASK_WEIGHTS[R.DEFAULT_TASK][i]}::DOUBLE END"


FLOOR = {s: R.FLOORS[a] for s, a in AXIS.items()}
DONE = "WHERE NOT skipped"
MEASURED = f"""m AS (SELECT result_id, model_id, task_id, coalesce(skipped, false) AS skipped, {mapped(tidy('domain'), R.LEGACY_DOMAINS)} AS domain, {mapped(tidy('task_category'), R.LEGACY_TASKS)} AS task_category,
 {tidy('motion_type')} AS motion_type, {', '.join(f'{clean(c)} AS {s}' for s, c in RAW.items())}, {clean('viewpoint_motion_score')} AS motion, {clean('viewpoint_motion_score')} AS angle, scored IS NOT NULL AS has_score,
 CASE WHEN len(industrial_constraint_details.invariants_checked) > 0 THEN greatest(0.0::DOUBLE, 1.0 - len(industrial_constraint_details.violations)::DOUBLE / len(industrial_constraint_details.invariants_checked)) END AS "constraint",
 industrial_constraint_details.violations AS violations, industrial_constraint_details.invariants_checked AS invariants FROM sample_results)"""
FOLDED = f"""k AS (SELECT *, {clamp('motion')} AS cm, {clamp('CASE WHEN "constraint" <= 1 THEN "constraint" * 100 ELSE "constraint" END')} AS cc FROM m),
 f AS (SELECT * REPLACE (CASE WHEN cm IS NULL THEN reference WHEN reference IS NULL THEN cm ELSE 0.7::DOUBLE * reference + 0.3::DOUBLE * cm END AS reference,
 CASE WHEN geometry IS NOT NULL AND cc IS NOT NULL THEN 0.7::DOUBLE * geometry + 0.3::DOUBLE * cc ELSE geometry END AS geometry) FROM k),
 g AS (SELECT * REPLACE ({', '.join(f'CASE WHEN {s} IS NOT NULL THEN greatest({FLOOR[s]}::DOUBLE, {s}) END AS {s}' for s in SHORT)}) FROM f)"""


def rif(a: str = "logic", b: str = "geometry", c: str = "reference") -> str:
    n = f"(({a} IS NOT NULL)::INT + ({b} IS NOT NULL)::INT + ({c} IS NOT NULL)::INT)"
    product = " * ".join(f"(CASE WHEN {x} IS NULL THEN 1::DOUBLE ELSE greatest({x}, 0::DOUBLE) END)" for x in (a, b, c))
    return f"CASE WHEN {n} >= 2 THEN pow({product}, 1.0::DOUBLE / {n}) END"


SCORED = f"""WITH {MEASURED}, {FOLDED},
 h AS (SELECT *, {' + '.join(f'({s} IS NOT NULL)::INT' for s in SHORT)} AS num_axes, {' + '.join(f'coalesce({s} * ({weight(s)}), 0)' for s in SHORT)} AS total, {' + '.join(f'CASE WHEN {s} IS NULL THEN 0 ELSE ({weight(s)}) END' for s in SHORT)} AS weights, {rif()} AS rif FROM g),
 scored AS (SELECT *, coalesce(total / nullif(weights, 0), 0) AS weighted_score, CASE WHEN greatest(angle, 0) < 0.05 AND angle IS NOT NULL THEN NULL ELSE rif END AS rif_gated,
 num_axes > 0 AND {' AND '.join(f'coalesce({s} >= 60, true)' for s in SHORT)} AS strict, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(motion, 100) / 100)) AS gate FROM h)"""
LONG = "long AS (" + " UNION ALL ".join(f"SELECT result_id, task_id, domain, task_category, {text(a)} AS axis, {i} AS ord, {s} AS score FROM scored WHERE NOT skipped AND {s} IS NOT NULL" for i, (s, a) in enumerate(AXIS.items())) + ")"
TIER = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} < 5 THEN 'none' WHEN {0} < 20 THEN 'weak' WHEN {0} < 60 THEN 'moderate' ELSE 'full' END"
METRICS = f"""count(*) AS num_samples_total, count(*) FILTER (WHERE NOT skipped AND has_score) AS num_samples_completed, count(*) FILTER (WHERE skipped OR NOT has_score) AS num_samples_skipped,
 avg(weighted_score) FILTER (WHERE NOT skipped AND has_score) AS relax_score, avg(strict::INT::DOUBLE) FILTER (WHERE NOT skipped AND has_score) AS strict_pass_rate, avg(weighted_score * gate) FILTER (WHERE NOT skipped AND has_score) AS gated_score,
 avg(angle) FILTER (WHERE NOT skipped AND has_score) AS mean_motion, {', '.join(f'avg({s}) FILTER (WHERE NOT skipped AND has_score) AS {s}' for s in SHORT)}"""


def finish(keys: str, source: str, extra: str = "") -> str:
    floors = ", ".join(f"CASE WHEN {s} IS NOT NULL THEN greatest({FLOOR[s]}::DOUBLE, {s}) END AS {s}" for s in SHORT)
    return f"""fl AS (SELECT * REPLACE ({floors}) FROM {source}), fi AS (SELECT *, {rif()} AS rif FROM fl),
 metrics AS (SELECT {keys}, coalesce(num_samples_total, 0) AS num_samples_total, coalesce(num_samples_completed, 0) AS num_samples_completed, coalesce(num_samples_skipped, 0) AS num_samples_skipped,
 coalesce(relax_score, 0) AS relax_score, coalesce(strict_pass_rate, 0) AS strict_pass_rate, coalesce(gated_score, 0) AS gated_score, coalesce(gated_score, 0) AS overall, {', '.join(SHORT)}, {TIER.format('mean_motion')} AS motion_tier,
 rif, CASE WHEN mean_motion < 0.05 THEN NULL ELSE rif END AS rif_gated, CASE WHEN mean_motion < 0.05 THEN 'rotation_integrity_factor_excluded_static_video' END AS rif_note,
 CASE WHEN coalesce(num_samples_completed, 0) = 0 THEN 'no_completed_samples' END AS note{extra} FROM fi)"""


def r6(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


NUM = ("relax_score", "strict_pass_rate", "gated_score", "overall", *SHORT, "rif", "rif_gated")
MODELS = f"""{SCORED}, a AS (SELECT model_id, {METRICS} FROM scored GROUP BY 1), j AS (SELECT models.model_id, model_name, a.* EXCLUDE (model_id) FROM models LEFT JOIN a ON models.model_id = a.model_id), {finish('model_id, model_name', 'j')}"""
RANKED = f"{MODELS}, ranked AS (SELECT *, row_number() OVER (ORDER BY round(overall, 6) DESC, model_name, model_id) AS rank FROM metrics)"
SETS = f"""{SCORED}, a0 AS (SELECT model_id, domain, task_category, grouping(domain) AS gd, grouping(task_category) AS gt, {METRICS} FROM scored GROUP BY GROUPING SETS ((model_id), (model_id, domain), (model_id, task_category))),
 a AS (SELECT *, CASE WHEN gd = 0 THEN 'domain' WHEN gt = 0 THEN 'task_category' ELSE 'model' END AS level FROM a0), b AS (SELECT * FROM a WHERE level = 'model' OR coalesce(domain, task_category) IS NOT NULL),
 {finish('model_id, level, domain, task_category', 'b', ', coalesce(physics, 100) < 35 AS physics_low, coalesce(geometry, 100) < 35 AS geometry_low')}"""
DEC1 = "coalesce(printf('%.1f', round(round({0}, 6), 1)), '-')"
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) AS rn FROM samples WHERE task_id IS NOT NULL) WHERE rn = 1)"
FRAMES = "WITH fr AS (SELECT user_id AS video, value, event_id, event_id % 5 AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, count(*) OVER (PARTITION BY user_id) AS frames FROM events)"
VECTORS = "WITH v AS (SELECT label AS video, embedding::DOUBLE[] AS vector, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings), w AS (SELECT *, lag(vector) OVER (PARTITION BY video ORDER BY frame) AS previous FROM v)"
CLIPS = """WITH c0 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey % 900) / 10.0::DOUBLE END AS motion, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 120)::DOUBLE END AS target FROM orders),
 clips AS (SELECT *, CASE WHEN motion IS NOT NULL AND target IS NOT NULL THEN round(100 * greatest(0.0::DOUBLE, 1 - abs(motion - target) / 45), 4) END AS fidelity FROM c0)"""
ASKED = "asked AS (SELECT row_id, task_id, i AS pos, q.id AS qid, q.text AS question, q.answer AS expected, coalesce(nullif(q.weakness_target, ''), 'untagged') AS tag FROM (SELECT row_id, task_id, unnest(industrial_logic_questions) AS q, generate_subscripts(industrial_logic_questions, 1) AS i FROM samples))"


def verdict(c: str) -> str:
    w = f"regexp_extract(trim(lower({c})), '^\\S*')"
    return f"CASE WHEN starts_with({w}, 'y') THEN 'yes' WHEN starts_with({w}, 'n') THEN 'no' END"


def any_of(c: str, words: tuple[str, ...]) -> str:
    return f"coalesce(({' OR '.join(f'contains(lower({c}), {text(w)})' for w in words)}), false)"


def any_term(c: str, terms: tuple[str, ...]) -> str:
    return f"regexp_matches({c}, {text('(^|[^a-z0-9])(' + '|'.join(terms) + ')([^a-z0-9]|$)')})"


ANSWERS = f"""answers AS (SELECT row_id, pos, ['Yes.', 'no', '  YES it remains intact', 'not sure', ''][((row_id * 7 + pos * 3) % 5 + 1)::INT] AS answer, CASE WHEN row_id % 3 = 0 THEN 'No cracking: the frame is structurally sound.' ELSE '' END AS reasoning FROM asked WHERE (row_id + pos) % 7 <> 0),
 joined AS (SELECT asked.*, coalesce(answer, '') AS answer, coalesce(reasoning, '') AS reasoning FROM asked LEFT JOIN answers USING (row_id, pos)),
 outcomes AS (SELECT *, CASE WHEN ({verdict('expected')}) = ({verdict('answer')}) THEN 'correct' WHEN ({verdict('expected')}) = 'no' AND ({verdict('answer')}) = 'yes' AND {any_of('question', R.FAILURE_WORDS)} AND {any_of("coalesce(nullif(reasoning, ''), answer)", R.CORRECTNESS_PHRASES)} THEN 'superlative' ELSE 'wrong' END AS outcome FROM joined)"""
QA = f"WITH {ASKED}, {ANSWERS}"


def calibration(bucket: str, score: str) -> str:
    return f"""{SCORED}, {LATEST}, t AS (SELECT task_id, {bucket} AS bucket FROM latest WHERE cardinality(difficulty_profile) > 0), b AS (SELECT bucket, avg({score}) AS mean, count({score}) AS n FROM scored JOIN t USING (task_id) {DONE} GROUP BY 1),
 g2 AS (SELECT * FROM (VALUES {', '.join(f'({text(k)}, {v}::DOUBLE)' for k, v in R.BUCKET_TARGETS.items())}) AS x(bucket, target)) SELECT bucket, round(target, 6) AS target, round(coalesce(mean, 0), 6) AS mean, coalesce(n, 0) AS n, coalesce(mean, 0) > target AS above_target FROM g2 LEFT JOIN b USING (bucket)"""


LEVELS = "list_transform(map_values(difficulty_profile), lambda v: lower(trim(v)))"
WORST = "CASE " + " ".join(f"WHEN list_contains({LEVELS}, '{b}') THEN '{b}'" for b in ("adversarial", "hard", "medium", "easy")) + " ELSE 'medium' END"


def checker_rows() -> str:
    rows = ", ".join(f"({text(d)}, {text(t)}, {text(','.join(f'{c}:{a}' for c, a in cs))})" for (d, t), cs in R.CHECKERS.items())
    other = ", ".join(f"({text(t)}, {text(','.join(f'{c}:{a}' for c, a in cs))})" for t, cs in R.FALLBACK_CHECKERS.items())
    return f"ck AS (SELECT * FROM (VALUES {rows}) AS x(domain, topology, names)), fb AS (SELECT * FROM (VALUES {other}) AS y(task_category, other))"


SEARCH = "concat_ws(' ', CASE WHEN starts_with(lower(coalesce(prompt, '')), 'task objective:') THEN '' ELSE lower(coalesce(prompt, '')) END, regexp_extract(lower(coalesce(image_path, '')), '[^/\\\\]*$'), lower(coalesce(task_id, '')))"
INFERRED = f"""inf0 AS (SELECT *, {SEARCH} AS words, {mapped(tidy('task_category'), R.LEGACY_TASKS)} AS declared, coalesce({mapped(tidy('domain'), R.LEGACY_DOMAINS)}, '') AS dom, coalesce(nullif(primary_topology, ''), topology_type, '') AS topo, coalesce({tidy('motion_type')}, '') AS mo FROM samples),
 inferred AS (SELECT *, CASE WHEN declared IN ({', '.join(map(text, R.TASK_WEIGHTS))}) THEN declared WHEN dom = 'visual_security' OR {any_term('words', R.LOGIC_TERMS)} THEN 'industrial_logic_and_compliance'
 WHEN {any_term('words', R.FLUID_TERMS)} THEN 'fluid_dynamics_and_thermodynamics' WHEN {any_term('words', R.FAILURE_TERMS)} OR coalesce(sub_topology, '') IN ('2d_planar', 'rotational') OR topo = 'lattice' THEN 'topology_mutation_and_failure'
 WHEN ({any_term('words', R.VIEWPOINT_TERMS)} OR mo IN ('orbit', 'pan', 'dolly', 'crane', 'tilt')) AND NOT {any_term('words', R.RIGID_TERMS)} THEN 'spatial_exploration_and_viewpoint'
 WHEN {any_term('words', R.RIGID_TERMS)} OR topo IN ('kinematic', 'flexible') THEN 'rigid_body_kinematics_and_coupling' ELSE CASE dom {' '.join(f'WHEN {text(k)} THEN {text(v)}' for k, v in R.DOMAIN_TASKS.items())} ELSE {text(R.DEFAULT_TASK)} END END AS inferred_task FROM inf0)"""


def score_of(t: str, strip: str) -> str:
    cut = f"rtrim(w, {text(strip)})" if strip else "w"
    return f"list_filter(list_transform(regexp_split_to_array(trim({t}), '\\s+'), lambda w: CASE WHEN regexp_matches({cut}, '^[0-9]{{1,9}}$') THEN {cut}::INT END), lambda n: n BETWEEN 0 AND 100)[1]"


RESPONSE = "[(event_id % 137)::VARCHAR || chr(10) || 'minor issue', (event_id % 137)::VARCHAR || '% sure', 'score ' || (event_id % 137)::VARCHAR || ' then 70.', '', '  ', 'Fine.' || chr(10) || 'I say ' || (event_id % 137)::VARCHAR || ';', 'no score', '(' || (event_id % 137)::VARCHAR || ') 12'][event_id % 8 + 1]"


def violation_rules() -> str:
    rows = [(f, "required", f"{f} IS NULL") for f in ("task_id", "domain", "topology_type", "image_path", "prompt", "video_generation_prompt", "motion_type", "viewpoint_motion_target", "difficulty_profile", "constraint_annotations", "industrial_logic_questions", "sensitivity_variants")]
    rows += [(f, "enum", f"{f} NOT IN ({', '.join(map(text, v))})") for f, v in R.ENUMS.items()]
    rows += [("difficulty_profile", "enum", f"len(list_filter(map_values(difficulty_profile), lambda v: v NOT IN ({', '.join(map(text, R.BUCKET_TARGETS))}))) > 0")]
    rows += [("task_id", "pattern", "NOT regexp_matches(task_id, '^[a-z]{2,8}(_[a-z]+){0,2}_[0-9]{3}$|^S[A-Z][0-9]{2}$')"), ("image_path", "pattern", "NOT regexp_matches(image_path, '^dataset[\\\\/]images(_hq)?[\\\\/]')")]
    rows += [(f, "minLength", f"length({f}) < {n}") for f, n in (("prompt", 50), ("video_generation_prompt", 50), ("application_value", 20))]
    rows += [("viewpoint_motion_target", "oneOf", "try_cast(trim(viewpoint_motion_target) AS DOUBLE) IS NULL AND NOT regexp_matches(viewpoint_motion_target, '^(orbit_(cw|ccw)_[0-9]+deg|crane_up_[0-9]+deg|horizontal_pan_lr|dolly_in_[0-9]+x)$')")]
    rows += [("industrial_logic_questions.items", "required", "len(list_filter(industrial_logic_questions, lambda q: q.id IS NULL OR q.text IS NULL OR q.answer IS NULL)) > 0"), ("sensitivity_variants.items", "required", "len(list_filter(sensitivity_variants, lambda v: v.id IS NULL OR v.difficulty IS NULL OR v.prompt_delta IS NULL OR v.viewpoint_motion_target_delta IS NULL)) > 0")]
    rows += [("axis_weights", "minimum", "list_min(map_values(axis_weights)) < 0"), ("industrial_logic_questions", "minItems", "len(industrial_logic_questions) < 3")]
    rows += [("industrial_logic_questions.answer", "enum", "len(list_filter(industrial_logic_questions, lambda q: q.answer NOT IN ('yes', 'no'))) > 0"), ("industrial_logic_questions.weakness_target", "pattern", "len(list_filter(industrial_logic_questions, lambda q: NOT regexp_matches(q.weakness_target, '^W[2-7]$'))) > 0")]
    return " UNION ALL ".join(f"SELECT row_id, task_id, {text(p)} AS path, {text(r)} AS rule FROM samples WHERE {bad}" for p, r, bad in rows)


# The sections as the reference defines them: the motion section ends before "Industrial logic" or "No zoom.", the subject at the first full stop.
CLAUSE = """trim(regexp_extract(prompt, '(?is)Motion requirement / viewpoint motion fidelity:\\s*(.*?)(\\.\\s*Industrial logic|\\.\\s*No zoom\\.)', 1), chr(32) || chr(9) || chr(10) || chr(13))"""
SUBJECT = "trim(CASE WHEN contains(lower(prompt), 'reference subject:') THEN regexp_extract(prompt, '(?i)Reference subject:\\s*([^.]+)[.]', 1) ELSE '' END, chr(32) || chr(9) || chr(10) || chr(13))"
MOVING = "mo IN ('orbit', 'pan', 'dolly')"
HAS_UNIT = f"({any_of('cl', R.UNIT_MARKERS)} OR coalesce(mo = 'dolly' AND regexp_matches(cl, '\\b\\d+(\\.\\d+)?x\\b'), false) OR coalesce(mo IN ('orbit', 'pan') AND regexp_matches(cl, '\\b\\d+(\\.\\d+)?\\s*(°|deg|degree)'), false) OR {any_of('target', R.UNIT_MARKERS)})"
AUDIT_RULES = (
    ("unexpected_motion_type", "mo NOT IN ('orbit', 'pan', 'dolly', 'crane')", 3),
    ("motion_type_not_in_clause", "mo IN ('orbit', 'pan', 'dolly', 'crane') AND NOT contains(cl, mo)", 3),
    ("crane_without_crane_verb", "mo = 'crane' AND NOT contains(cl, 'crane')", 3),
    ("subject_names_crane", f"{MOVING} AND contains(cl, mo) AND contains(lower(subject), 'crane')", 3),
    ("no_unit", f"{MOVING} AND NOT {HAS_UNIT}", 2),
    ("no_structure", f"{MOVING} AND NOT {any_of('cl', R.STRUCTURE_MARKERS)}", 2),
    ("buried_verb", f"{MOVING} AND starts_with(cl, 'perform a controlled')", 1),
    ("pan_tied_to_leak", "mo = 'pan' AND contains(cl, 'follows the evolving leak')", 1),
)
def audit(source: str) -> str:
    return f"""WITH a0 AS (SELECT row_id, task_id, {tidy('motion_type')} AS motion, coalesce({tidy('motion_type')}, '') AS mo, lower(coalesce({CLAUSE}, '')) AS cl, coalesce({CLAUSE}, '') AS clause, coalesce({SUBJECT}, '') AS subject, viewpoint_motion_target AS target FROM {source}),
 a1 AS (SELECT row_id, task_id, motion, mo, clause, subject, CASE WHEN mo = 'static' THEN [] ELSE list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in AUDIT_RULES)}], lambda x: x IS NOT NULL) END AS issues,
 greatest({', '.join(f'CASE WHEN {c} THEN {r} ELSE 1 END' for _, c, r in AUDIT_RULES)}) AS rank FROM a0), audit AS (SELECT *, CASE WHEN mo = 'static' THEN 'none' ELSE ['low', 'medium', 'high'][rank] END AS severity FROM a1)"""

AUDIT = audit("samples")
SECTIONED = audit("(SELECT * REPLACE (regexp_replace(regexp_replace(prompt, '(Motion requirement|Camera|Viewpoint): ', 'Motion requirement / viewpoint motion fidelity: ', 'g'), '; ([A-Z])', '. \\1', 'g') || ' No zoom.' AS prompt) FROM samples)")

SQL: dict[str, str] = {
    "leaderboard": f"{RANKED} SELECT rank, model_id, model_name, {r6('overall', 'relax_score', 'strict_pass_rate', 'gated_score', *SHORT)}, motion_tier, num_samples_completed FROM ranked",
    "leaderboard_markdown": f"{RANKED} SELECT rank, '| ' || rank::VARCHAR || ' | ' || coalesce(model_name || ' | ', '') || {' || chr(32) || chr(124) || chr(32) || '.join(DEC1.format(c) for c in ('overall', 'relax_score', *SHORT))} || ' |' AS line FROM ranked",
    "sample_scores": f'{SCORED} SELECT result_id, {r6(*SHORT, "motion")}, round("constraint", 6) AS "constraint", num_axes::BIGINT AS num_axes, {r6("weighted_score", "rif", "rif_gated")}, strict, round(gate, 6) AS gate FROM scored',
    "axis_long_canonical": " UNION ALL ".join(f"SELECT result_id, {text(a)} AS axis, round(score, 6) AS score FROM (SELECT result_id, {clean(c)} AS score FROM sample_results) WHERE score IS NOT NULL" for a, c in [*((AXIS[s], c) for s, c in RAW.items()), (R.MOTION, "viewpoint_motion_score")]),
    "axis_floors": " UNION ALL ".join(f"SELECT result_id, {text(a)} AS axis, round(greatest(score, {R.FLOORS[a]}::DOUBLE), 6) AS score FROM (SELECT result_id, {clean(c)} AS score FROM sample_results) WHERE score IS NOT NULL" for a, c in [*((AXIS[s], c) for s, c in RAW.items()), (R.MOTION, "viewpoint_motion_score")]),
    "axis_floor_nan": "SELECT result_id, " + ", ".join(f"round(CASE WHEN {c} IS NULL OR {c} = 'inf'::DOUBLE THEN NULL WHEN isnan({c}) THEN {f} ELSE greatest({f}::DOUBLE, {c}) END, 6) AS {n}" for n, c, f in (("geometry", RAW["geometry"], 8), ("logic", RAW["logic"], 5))) + " FROM sample_results",
    "sanitize_nan": f"SELECT result_id, {', '.join(f'round(CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END, 6) AS {s}' for s, c in RAW.items())}, round(CASE WHEN isnan(scored.weighted_score) OR isinf(scored.weighted_score) THEN NULL ELSE scored.weighted_score END, 6) AS weighted FROM sample_results",
    "target_parse": "SELECT row_id, round(CASE WHEN regexp_matches(trim(viewpoint_motion_target), '^(orbit_cw|orbit_ccw|crane_up)_.*deg$') THEN try_cast(replace(split_part(trim(viewpoint_motion_target), '_', -1), 'deg', '') AS DOUBLE) ELSE try_cast(trim(viewpoint_motion_target) AS DOUBLE) END, 6) AS target FROM samples",
    "motion_fidelity": f"{CLIPS} SELECT o_orderkey, round(fidelity, 3) AS fidelity, {TIER.format('motion')} AS tier, round(degrees(atan2(abs(motion), 540 / tan(radians(30)))), 6) AS crane, motion < CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.8 END AS static FROM clips",
    "motion_diagnostics": f"{CLIPS} SELECT count(abs(motion - target)) AS targeted, round(avg(abs(motion - target)), 6) AS mean_abs_error, round(median(abs(motion - target)), 6) AS median_abs_error, count(*) FILTER (WHERE o_orderkey % 22 = 0) AS uncalculable, count(*) FILTER (WHERE motion < 0.05) AS static, count(*) FILTER (WHERE fidelity < 60) AS low FROM clips WHERE o_orderkey % 13 <> 0",
    "model_aggregate": f"{MODELS} SELECT * REPLACE ({r6(*NUM)}) FROM metrics",
    "breakdown_sets": f"{SETS} SELECT * REPLACE ({r6(*NUM)}) FROM metrics",
    "low_fidelity_domains": f"{SETS} SELECT model_id, coalesce(string_agg(domain, ',' ORDER BY domain) FILTER (WHERE physics_low), '') AS physics_low_domains, coalesce(string_agg(domain, ',' ORDER BY domain) FILTER (WHERE geometry_low), '') AS geometry_low_domains FROM metrics WHERE level = 'domain' GROUP BY 1",
    "rif_by_model": f"{SCORED} SELECT model_id, round(avg(rif), 6) AS mean_rif, count(rif) AS with_rif, count(rif_gated) AS with_gated, round(avg(rif_gated), 6) AS mean_gated FROM scored {DONE} GROUP BY 1",
    "axis_statistics": f"{SCORED}, {LONG} SELECT axis, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(min(score), 6) AS min, round(max(score), 6) AS max, count(*) AS n, round(avg((score < 60)::INT::DOUBLE), 6) AS low_rate FROM long GROUP BY 1",
    "weakest_axes": f"{SCORED}, {LONG} SELECT axis, round(avg(score), 6) AS mean FROM long GROUP BY 1 ORDER BY avg(score), axis LIMIT 5",
    "group_scores": f"""{SCORED}, {LATEST}, t AS (SELECT task_id, coalesce(nullif(primary_topology, ''), nullif(topology_type, ''), 'kinematic') AS pt, coalesce(sub_topology, '') AS st FROM latest), r AS (SELECT scored.*, pt, st FROM scored LEFT JOIN t USING (task_id) {DONE} AND has_score),
 p AS (SELECT 'domain' AS property, domain AS value, weighted_score AS ws FROM r UNION ALL SELECT 'primary_topology', pt, weighted_score FROM r UNION ALL SELECT 'sub_topology', st, weighted_score FROM r UNION ALL SELECT 'motion_type', motion_type, weighted_score FROM r)
 SELECT property, value, count(*) AS n, round(avg(ws), 6) AS mean_weighted_score, round(avg((ws < 60)::INT::DOUBLE), 6) AS low_rate FROM p WHERE value IS NOT NULL GROUP BY 1, 2""",
    "constraint_counts": f"{SCORED}, e AS (SELECT result_id, 'checker' AS kind, unnest(invariants) AS name FROM scored {DONE} UNION ALL SELECT result_id, 'violation', split_part(unnest(violations), ':', 1) FROM scored {DONE}), c AS (SELECT kind, name, count(*) AS n, min(result_id) AS first_seen FROM e GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, first_seen, name) AS position FROM c",
    "constraint_summary": f'{SCORED} SELECT round(avg("constraint" * 100), 6) AS mean_constraint, count("constraint") AS with_constraint FROM scored {DONE}',
    "ability_failures": f"{SCORED}, {LONG}, w AS (SELECT axis, avg(score) AS mean, count(*) FILTER (WHERE score < 60) AS low_count, avg((score < 60)::INT::DOUBLE) AS low_rate FROM long GROUP BY 1), d AS (SELECT axis, domain AS k, count(*) AS n FROM long WHERE score < 60 AND domain IS NOT NULL GROUP BY 1, 2), t AS (SELECT axis, task_category AS k, count(*) AS n FROM long WHERE score < 60 AND task_category IS NOT NULL GROUP BY 1, 2), d2 AS (SELECT axis, string_agg(k || '=' || n::VARCHAR, ',' ORDER BY n DESC, k) AS by_domain FROM d GROUP BY 1), t2 AS (SELECT axis, string_agg(k || '=' || n::VARCHAR, ',' ORDER BY n DESC, k) AS by_task_category FROM t GROUP BY 1) SELECT axis, round(mean, 6) AS mean, low_count, round(low_rate, 6) AS low_rate, by_domain, by_task_category FROM w LEFT JOIN d2 USING (axis) LEFT JOIN t2 USING (axis)",
    "worst_samples": f"{SCORED}, x AS (SELECT * REPLACE (round(weighted_score, 6) AS weighted_score) FROM scored {DONE} ORDER BY round(weighted_score, 6), result_id LIMIT 12), y AS (SELECT *, list_sort(list_filter([{', '.join(f'CASE WHEN {s} IS NOT NULL THEN {{v: {s}, o: {i}, a: {text(AXIS[s])}}} END' for i, s in enumerate(SHORT))}], lambda e: e IS NOT NULL))[1] AS low FROM x) SELECT result_id, task_id, domain, motion_type, weighted_score, low.a AS weakest_axis, round(low.v, 6) AS weakest_score, round(motion, 6) AS motion FROM y",
    "worst_per_axis": f"{SCORED}, {LONG}, o AS (SELECT result_id, task_id, domain, task_category, axis, round(score, 6) AS score, row_number() OVER (PARTITION BY axis ORDER BY round(score, 6), result_id) AS position FROM long) SELECT * FROM o WHERE position <= 8",
    "weakest_axis_per_sample": f"{SCORED}, y AS (SELECT result_id, list_sort(list_filter([{', '.join(f'CASE WHEN {s} IS NOT NULL THEN {{v: round({s}, 6), o: {i}, a: {text(AXIS[s])}}} END' for i, s in enumerate(SHORT))}], lambda e: e IS NOT NULL))[1] AS low FROM scored {DONE}) SELECT result_id, low.a AS weakest_axis, low.v AS weakest_score FROM y",
    "difficulty_calibration": calibration(WORST, "weighted_score"),
    "axis_calibration": calibration(f"coalesce(lower(trim(difficulty_profile[{text(R.GEOMETRY)}])), 'medium')", "geometry"),
    "checker_dispatch": f"WITH {checker_rows()}, s AS (SELECT row_id, {tidy('domain')} AS domain, topology_type AS topology, {mapped(tidy('task_category'), R.LEGACY_TASKS)} AS task_category FROM samples) SELECT row_id, coalesce(names, other) AS checkers FROM s LEFT JOIN ck USING (domain, topology) LEFT JOIN fb USING (task_category)",
    "infer_task_category": f"WITH {INFERRED} SELECT row_id, inferred_task FROM inferred",
    "effective_weights": f"WITH {INFERRED}, own AS (SELECT row_id, {mapped('k', R.AXIS_ALIASES)} AS axis, w AS weight FROM (SELECT row_id, unnest(map_keys(axis_weights)) AS k, unnest(map_values(axis_weights)) AS w FROM samples)), prof AS (SELECT * FROM (VALUES {', '.join(f'({text(t)}, {text(a)}, {w}::DOUBLE)' for t, ws in R.TASK_WEIGHTS.items() for a, w in zip(R.AXES, ws))}) AS p(inferred_task, axis, weight)), big AS (SELECT row_id, axis, weight, 1 AS pri FROM own UNION ALL SELECT row_id, axis, weight, 2 FROM inferred JOIN prof USING (inferred_task)) SELECT row_id, axis, round(arg_max(weight, pri), 6) AS weight FROM big GROUP BY 1, 2",
    "question_scores": f"{QA} SELECT row_id, count(*) AS total, count(*) FILTER (WHERE outcome <> 'wrong') AS correct, count(*) FILTER (WHERE outcome = 'superlative') AS superlative, round(avg((outcome <> 'wrong')::INT::DOUBLE), 6) AS accuracy FROM outcomes GROUP BY 1",
    "weakness_accuracy": f"{QA} SELECT tag, count(*) AS total, count(*) FILTER (WHERE outcome <> 'wrong') AS correct, round(avg((outcome <> 'wrong')::INT::DOUBLE), 6) AS accuracy FROM outcomes GROUP BY 1",
    "answer_join": f"{QA} SELECT row_id, pos::BIGINT AS pos, qid, expected, answer, outcome FROM outcomes",
    "positional_join": f"WITH {ASKED} SELECT row_id, pos::BIGINT AS pos, CASE row_id % 4 WHEN 0 THEN CASE pos WHEN 1 THEN 'yes' ELSE 'no' END WHEN 2 THEN CASE pos WHEN 1 THEN 'yes' ELSE 'no' END ELSE 'no' END AS answer FROM asked",
    "score_parse": f"WITH t AS (SELECT event_id, trim({RESPONSE}, ' ' || chr(9) || chr(10) || chr(13)) AS t, {RESPONSE} AS raw FROM events) SELECT event_id, coalesce({score_of('t', '')}, 50)::BIGINT AS plain, coalesce({score_of('t', '.,;:)')}, 50)::BIGINT AS marks, coalesce({score_of('split_part(t, chr(10), 1)', '.,;:)%')}, {score_of('t', '.,;:)%')}, 50)::BIGINT AS lines, {verdict('raw')} AS verdict FROM t",
    "score_sources": "WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS j, CASE WHEN event_id % 4 <> 0 THEN value / 2 END AS m FROM events) SELECT event_id, CASE WHEN j IS NOT NULL THEN 'judge' WHEN m IS NOT NULL THEN 'measured' ELSE 'absent' END AS source, round(coalesce(j, m), 6) AS score, round(CASE WHEN j IS NOT NULL THEN 0.4 * m + 0.6 * j ELSE m END, 6) AS temporal, round(CASE WHEN j IS NOT NULL THEN 0.5 * (0.6 * m + 0.4 * 75) + 0.5 * j ELSE 0.6 * m + 0.4 * 75 END, 6) AS fidelity, round(0.6 * j + 0.4 * m, 6) AS kinematic FROM e",
    "schema_violations": violation_rules(),
    "motion_audit": f"{AUDIT} SELECT row_id, motion, array_to_string(issues, ',') AS issues, severity FROM audit",
    "issue_counts": f"{AUDIT}, u AS (SELECT 'issue' AS kind, unnest(issues) AS name FROM audit WHERE severity <> 'none' UNION ALL SELECT 'severity', severity FROM audit WHERE severity <> 'none' AND len(issues) > 0 UNION ALL SELECT 'motion', coalesce(motion, 'none') FROM audit WHERE severity <> 'none' AND len(issues) > 0) SELECT kind, name, count(*) AS n FROM u GROUP BY 1, 2",
    "motion_audit_sections": f"{SECTIONED} SELECT row_id, motion, md5(clause) AS clause, md5(subject) AS subject, array_to_string(issues, ',') AS issues, severity FROM audit",
    "issue_index": f"{SECTIONED} SELECT unnest(issues) AS issue, row_id, task_id FROM audit",
    "review_order": f"{SECTIONED} SELECT row_id, severity, (CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END)::BIGINT AS rank FROM audit WHERE len(issues) > 0",
    "prompt_rules": f"""WITH n AS (SELECT *, {tidy('motion_type')} AS mo, regexp_extract(prompt, 'target motion value (\\d+(?:\\.\\d+)?)', 1) AS num, regexp_extract(prompt, 'target motion value (\\d+(?:\\.\\d+)?)([\\d.]*[\\dx°])?', 2) AS tail FROM samples),
 o AS (SELECT *, num <> '' AND tail = '' AS ok, coalesce(mo = 'dolly' OR (NOT coalesce(mo IN ('orbit', 'pan'), false) AND try_cast(num AS DOUBLE) < 10), false) AS ratio FROM n)
 SELECT row_id, md5(CASE WHEN video_generation_prompt LIKE '%No zoom.' THEN video_generation_prompt WHEN video_generation_prompt LIKE '%No zoom' THEN video_generation_prompt || '.' ELSE video_generation_prompt || ' No zoom.' END) AS closed,
 md5(CASE WHEN ok THEN replace(prompt, 'target motion value ' || num, 'target motion value ' || CASE WHEN ratio THEN num || 'x' ELSE regexp_replace(num, '\\.0+$', '') || '°' END) ELSE prompt END) AS completed, regexp_replace(regexp_extract(image_path, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') AS stem,
 CASE WHEN {any_of(CLAUSE, R.STRUCTURE_MARKERS)} THEN 'pass_motion' WHEN mo = 'static' THEN 'fail_motion' ELSE 'weak_motion' END AS visibility FROM o""",
    "variant_flags": f"WITH s AS (SELECT row_id, {tidy('motion_type')} AS motion, video_generation_prompt AS t, sensitivity_variants AS vs FROM samples), u AS (SELECT row_id, motion, unnest(vs) AS v FROM s), f AS (SELECT 'missing_no_zoom_suffix' AS flag FROM s WHERE t NOT LIKE '%No zoom.' UNION ALL SELECT 'variant_' || coalesce(v.difficulty, 'any') || '_mentions_orbit_but_motion_is_' || motion FROM u WHERE contains(lower(v.prompt_delta), 'orbit') AND motion <> 'orbit') SELECT flag, count(*) AS n FROM f GROUP BY 1",
    "prompt_export": f"WITH {LATEST} SELECT task_id, domain, task_category, image_path, motion_type, viewpoint_motion_target, coalesce(video_generation_prompt, prompt) AS video_generation_prompt, prompt FROM latest",
    "prompt_headers": f"WITH {LATEST}, o AS (SELECT task_id, coalesce(domain, '') AS d, coalesce(task_category, '') AS c FROM latest) SELECT task_id, CASE WHEN row_number() OVER (PARTITION BY d ORDER BY c, task_id) = 1 THEN '## ' || d END AS domain_header, CASE WHEN row_number() OVER (PARTITION BY d, c ORDER BY task_id) = 1 THEN '### ' || c END AS task_header FROM o",
    "reuse_counts": "SELECT image_path, row_id, task_id, CASE WHEN image_path IS NOT NULL THEN count(*) OVER (PARTITION BY image_path) END AS reuse FROM samples",
    "dedupe_keep_first": "WITH h AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL) SELECT doc_id, hash, count(*) OVER (PARTITION BY hash) AS copies, min(doc_id) OVER (PARTITION BY hash) AS kept, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY hash) THEN 'keep' ELSE 'delete' END AS action FROM h",
    "token_candidates": f"""WITH q AS (SELECT DISTINCT p_partkey AS query, unnest(regexp_split_to_array(lower(concat_ws(' ', p_name, p_type)), '[^a-z0-9]+')) AS token FROM part), i AS (SELECT DISTINCT asset_id AS item, unnest(regexp_split_to_array(lower(concat_ws(' ', asset_name, domain)), '[^a-z0-9]+')) AS token FROM assets),
 sc AS (SELECT query, item, count(*) AS s FROM q JOIN i USING (token) WHERE length(token) >= 3 AND token NOT IN ({', '.join(map(text, R.STOP_TOKENS))}) GROUP BY 1, 2 UNION ALL SELECT p_partkey, asset_id, 3 FROM part JOIN assets ON asset_id = p_partkey % 400 + 1), t AS (SELECT query, item, sum(s)::BIGINT AS score FROM sc GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS position FROM t) SELECT * FROM r WHERE position <= 5""",
    "sourcing_plan": "",
    "image_sizes": "WITH p AS (SELECT p_partkey, p_size * 100 AS w, p_partkey % 40 * 90 + 200 AS h FROM part), s AS (SELECT *, least(1.0::DOUBLE, 1600.0::DOUBLE / greatest(w, h)) AS side FROM p), t AS (SELECT *, CASE WHEN w * h * side * side > 2250000 THEN sqrt(2250000.0::DOUBLE / (w * h)) ELSE side END AS scale FROM s) SELECT p_partkey, greatest(1, floor(w * scale))::BIGINT AS width, greatest(1, floor(h * scale))::BIGINT AS height, CASE WHEN least(w, h) < 700 THEN 'removed_too_small' ELSE 'kept' END AS status FROM t",
    "integrity_counts": "WITH h AS (SELECT DISTINCT task_id, true AS there FROM sample_results WHERE task_id IS NOT NULL) SELECT count(*) AS total, count(there) AS found, count(*) - count(there) AS missing FROM samples LEFT JOIN h USING (task_id) WHERE task_id IS NOT NULL",
    "missing_assets": "SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "keyed_samples": f"WITH {LATEST} SELECT task_id, row_id FROM latest",
    "flow_kinematic": f"{FRAMES}, s AS (SELECT video, avg(abs(value)) AS mean_flow, quantile_cont(abs(value), 0.8) AS p80 FROM fr GROUP BY 1) SELECT video, round(mean_flow, 6) AS mean_flow, round(p80, 6) AS p80, round(coalesce(CASE WHEN p80 <= 0 THEN 1 ELSE greatest(0.1, 1 - least(mean_flow / (p80 * 5), 1)) END, 1), 6) AS score, mean_flow < CASE WHEN mean_flow < 20 THEN 0.5 ELSE 0.8 END AS static FROM s",
    "count_invariant": f"{FRAMES}, n AS (SELECT video, greatest(1, round_even(median(n), 0)) AS nominal FROM fr GROUP BY 1), s AS (SELECT video, any_value(nominal) AS nominal, max(n) AS most, min(n) AS least, avg(greatest(0.1, 1 - 2 * abs(n - nominal) / nominal)) AS mean FROM fr JOIN n USING (video) GROUP BY 1) SELECT video, round(nominal::DOUBLE, 6) AS nominal, round(CASE WHEN most = 0 THEN 0.1 ELSE greatest(0.1, least(1, mean)) END, 5) AS score, most = least AND most > 0 AS stable FROM s",
    "merge_fraction": f"{FRAMES} SELECT video, round(avg((n < 2)::INT::DOUBLE), 6) AS merge_fraction, round(1 - avg((n < 2)::INT::DOUBLE), 6) AS score FROM fr GROUP BY 1",
    "coupling_cv": f"{FRAMES}, s AS (SELECT video, stddev_pop(value) / (avg(value) + 1e-8) AS cv FROM fr GROUP BY 1) SELECT video, round(cv, 6) AS cv, round(greatest(0.1, 1 - cv * 5), 6) AS score FROM s",
    "direction_consistency": f"{FRAMES}, a AS (SELECT *, value - lag(value) OVER (PARTITION BY video ORDER BY frame) AS d FROM fr), b AS (SELECT *, (sign(d) <> sign(lag(d) OVER (PARTITION BY video ORDER BY frame)))::INT AS turn FROM a), c AS (SELECT video, coalesce(sum(turn), 0)::BIGINT AS turns, count(d) AS steps, bool_and(d >= 0) AS up, bool_and(d <= 0) AS down FROM b GROUP BY 1) SELECT video, turns, steps, turns <= 0.15 * steps AS consistent, coalesce(up OR down, true) AS monotonic FROM c",
    "moving_average": f"{FRAMES} SELECT video, frame::BIGINT AS frame, round(sum(value) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) / 13, 6) AS smooth FROM fr",
    "peak_gap_merge": f"{FRAMES.replace('WITH', 'WITH RECURSIVE')}, p AS (SELECT video, frame FROM fr WHERE value > 20), k AS (SELECT video, min(frame) AS frame FROM p GROUP BY 1 UNION ALL SELECT k.video, (SELECT min(p.frame) FROM p WHERE p.video = k.video AND p.frame - k.frame > 5) FROM k WHERE k.frame IS NOT NULL) SELECT video, count(frame) AS groups, string_agg(frame::VARCHAR, ',' ORDER BY frame) AS kept FROM k WHERE frame IS NOT NULL GROUP BY 1",
    "anchor_pair": f'{FRAMES} SELECT video, round(arg_min(value, frame), 6) AS "first", round(arg_max(value, frame), 6) AS "last", round(arg_max(value, frame) FILTER (WHERE frame < frames - 1), 6) AS second_last FROM fr GROUP BY 1',
    "adjacent_pairs": f"{FRAMES}, a AS (SELECT video, frame::BIGINT AS frame, lag(value) OVER (PARTITION BY video ORDER BY frame) AS previous, value FROM fr) SELECT video, frame, round(previous, 6) AS previous, round(value, 6) AS value FROM a WHERE previous IS NOT NULL",
    "stride_sample": f"{FRAMES} SELECT video, frame::BIGINT AS frame FROM fr WHERE frame % greatest(1, frames // 8) = 0 OR frame = frames - 1",
    "even_sample": f"{FRAMES}, i AS (SELECT unnest(range(8)) AS i), p AS (SELECT DISTINCT video, round_even(i * (frames - 1) / 7.0::DOUBLE, 0)::BIGINT AS frame FROM fr, i) SELECT video, frame::BIGINT AS frame FROM fr WHERE frames <= 8 OR (video, frame) IN (SELECT (video, frame) FROM p)",
    "thirds_sample": f"{FRAMES} SELECT video, frame::BIGINT AS frame FROM fr WHERE frame IN (0, frames // 3, 2 * frames // 3, frames - 1)",
    "first_middle_last": f"{FRAMES} SELECT video, frame::BIGINT AS frame FROM fr WHERE frame IN (0, frames // 2, frames - 1)",
    "adjacent_cosine": f"{VECTORS} SELECT video::BIGINT AS video, round(avg(list_cosine_similarity(previous, vector)), 4) AS similarity, count(*) AS pairs FROM w WHERE previous IS NOT NULL GROUP BY 1",
    "nn_chamfer": f"""{VECTORS}, i AS (SELECT unnest(range(32)) AS i), a AS (SELECT video, frame, i, previous[2 * i + 1] AS x, previous[2 * i + 2] AS y FROM w, i WHERE previous IS NOT NULL), b AS (SELECT video, frame, i, vector[2 * i + 1] AS x, vector[2 * i + 2] AS y FROM w, i WHERE previous IS NOT NULL),
 d AS (SELECT a.video, a.frame, a.i AS ai, b.i AS bi, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM a JOIN b ON a.video = b.video AND a.frame = b.frame), l AS (SELECT video, frame, avg(m) AS v FROM (SELECT video, frame, ai, min(dist) AS m FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2), r AS (SELECT video, frame, avg(m) AS v FROM (SELECT video, frame, bi, min(dist) AS m FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2)
 SELECT l.video::BIGINT AS video, l.frame::BIGINT AS frame, round((l.v + r.v) / 2, 4) AS chamfer, round(greatest(0.1, 1 - (l.v + r.v) / 2), 4) AS score FROM l JOIN r ON l.video = r.video AND l.frame = r.frame""",
    "ratio_match": f"""{VECTORS}, i AS (SELECT unnest(range(8)) AS i), a AS (SELECT video, frame, i, previous[8 * i + 1 : 8 * i + 8] AS p FROM w, i WHERE previous IS NOT NULL), b AS (SELECT video, frame, i, vector[8 * i + 1 : 8 * i + 8] AS p FROM w, i WHERE previous IS NOT NULL),
 d AS (SELECT a.video, a.frame, a.i, list_distance(a.p, b.p) AS dist, row_number() OVER (PARTITION BY a.video, a.frame, a.i ORDER BY list_distance(a.p, b.p)) AS k FROM a JOIN b ON a.video = b.video AND a.frame = b.frame), t AS (SELECT video, frame, i, max(dist) FILTER (WHERE k = 1) AS d1, max(dist) FILTER (WHERE k = 2) AS d2 FROM d GROUP BY 1, 2, 3), m AS (SELECT video, frame, count(*) FILTER (WHERE d1 < 0.75 * d2) AS matches FROM t GROUP BY 1, 2)
 SELECT video::BIGINT AS video, frame::BIGINT AS frame, matches, round((CASE WHEN matches < 5 THEN 0.1 WHEN matches < 20 THEN 0.25 ELSE matches / 8.0 END)::DOUBLE, 4) AS score FROM m""",
    "pairwise_dist": f"{VECTORS}, p AS (SELECT unnest(range(4)) AS i), q AS (SELECT a.i AS i, b.i AS j FROM p a, p b WHERE a.i < b.i) SELECT video::BIGINT AS video, frame::BIGINT AS frame, i::BIGINT AS i, j::BIGINT AS j, round(sqrt(pow(vector[2 * i + 1] - vector[2 * j + 1], 2) + pow(vector[2 * i + 2] - vector[2 * j + 2], 2)), 4) AS length FROM v, q",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
}
SQL["resolve_images"] = """WITH p AS (SELECT DISTINCT path FROM (SELECT CASE WHEN row_id % 2 = 0 THEN regexp_replace(replace(image_path, '/images/', '/images_hq/'), '\\.[^.]*$', '') || '.png' ELSE image_path END AS path FROM samples) WHERE path IS NOT NULL),
 c AS (SELECT row_id, 1 AS k, regexp_replace(replace(image_path, '/images/', '/images_hq/'), '\\.[^.]*$', '') || '.png' AS path FROM samples UNION ALL SELECT row_id, 2, replace(image_path, '/images/', '/images_hq/') FROM samples UNION ALL SELECT row_id, 3, image_path FROM samples),
 h AS (SELECT row_id, arg_min(path, k) AS resolved FROM c JOIN p USING (path) GROUP BY 1) SELECT row_id, image_path, resolved FROM samples LEFT JOIN h USING (row_id)"""
SQL["lattice_score"] = "WITH e AS (SELECT event_id, least(event_id % 60, user_id % 70) AS l, event_id % 37 AS m, CASE WHEN event_id % 9 <> 0 THEN value / 100 END AS c FROM events) SELECT event_id, round(CASE WHEN l < 10 THEN 0.3::DOUBLE WHEN m < 5 THEN 0.1 WHEN m < 20 THEN 0.25 ELSE greatest(0.1, m::DOUBLE / l) END, 6) AS lattice, round(CASE WHEN c IS NULL THEN 0.1::DOUBLE ELSE greatest(0.1, 1 - c) END, 6) AS surface FROM e"
SQL["geometry_route"] = """WITH s AS (SELECT row_id, CASE sub_topology WHEN '2d_planar' THEN 'spectral' WHEN '3d_spatial' THEN 'lattice' WHEN 'aerodynamic' THEN 'surface' WHEN 'rigid_housing' THEN 'lattice' WHEN 'articulated' THEN 'articulated' WHEN 'rotational' THEN 'rotary' WHEN 'cable_hose' THEN 'kinematic'
 ELSE CASE primary_topology WHEN 'kinematic' THEN 'kinematic' WHEN 'flexible' THEN 'kinematic' WHEN 'lattice' THEN 'lattice' WHEN 'surface' THEN 'lattice' END END AS method FROM samples),
 t AS (SELECT *, coalesce(CASE method WHEN 'spectral' THEN row_id * 3 % 101 / 100.0::DOUBLE WHEN 'lattice' THEN row_id * 5 % 101 / 100.0::DOUBLE WHEN 'surface' THEN row_id * 7 % 101 / 100.0::DOUBLE WHEN 'articulated' THEN 0.6 * (row_id * 11 % 101 / 100.0::DOUBLE) + 0.4 * (row_id * 13 % 101 / 100.0::DOUBLE) WHEN 'rotary' THEN CASE WHEN row_id % 2 = 0 THEN row_id * 17 % 101 / 100.0::DOUBLE END WHEN 'kinematic' THEN row_id * 11 % 101 / 100.0::DOUBLE END, 0) AS score FROM s)
 SELECT row_id, method, round(score, 6) AS score, round(CASE WHEN method IN ('spectral', 'rotary') THEN 0 ELSE score END, 6) AS parity FROM t"""
SQL["constraint_mean"] = "SELECT user_id AS video, round(greatest(0, least(1, avg(CASE WHEN event_id % 5 <> 0 THEN event_id % 13 / 10.0::DOUBLE ELSE 0 END))), 4) AS \"constraint\", count(*) AS checkers FROM events GROUP BY 1"
SQL["viewpoint_motion"] = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS n, o_custkey % 40 / 10.0::DOUBLE AS flow FROM orders), p AS (SELECT *, CASE WHEN k % 3 <> 0 THEN k % 200 END AS s1, CASE WHEN k % 4 <> 0 THEN k % 90 END AS s2, CASE WHEN k % 7 <> 0 THEN k % 30 END AS s3, CASE WHEN k % 3 <> 0 THEN k % 360 - 180 END AS t1, CASE WHEN k % 5 <> 0 THEN k % 50 END AS t2, n < 2 OR flow < CASE WHEN k % 3 = 0 THEN 0.5 ELSE 0.8 END AS still FROM o)
 SELECT k AS o_orderkey, CASE WHEN still THEN 'static_detected' WHEN k % 2 = 0 THEN CASE WHEN s1 IS NOT NULL THEN 'affine' WHEN s2 IS NOT NULL THEN 'phase' WHEN s3 IS NOT NULL THEN 'flow' ELSE 'uncalculable' END WHEN t1 IS NOT NULL THEN 'anchor_to_final' WHEN t2 IS NOT NULL THEN 'anchor_to_second_last' ELSE 'uncalculable' END AS method,
 round(CASE WHEN still THEN 0 WHEN k % 2 = 0 THEN degrees(atan2(abs(coalesce(s1, s2, s3))::DOUBLE, 540 / tan(radians(30)))) ELSE abs(coalesce(t1, t2))::DOUBLE END, 6) AS value FROM p"""
SQL["clip_scores"] = """WITH e AS (SELECT event_id, event_id % 4 AS n, event_id % 100 / 100.0::DOUBLE AS s, CASE WHEN event_id % 3 = 0 THEN (event_id % 90)::DOUBLE END AS j, (event_id % 21 - 10) / 10.0::DOUBLE AS h FROM events), f AS (SELECT *, 0.6 * (s * 100) + 0.4 * ((h + 1) / 2 * 100) AS cv FROM e)
 SELECT event_id, round(CASE WHEN n >= 2 THEN round(CASE WHEN j IS NOT NULL THEN 0.4 * (s * 100) + 0.6 * j ELSE s * 100 END, 2) END, 1) AS temporal, round(CASE WHEN n >= 1 THEN round(greatest(0, least(100, CASE WHEN j IS NOT NULL THEN 0.5 * cv + 0.5 * j ELSE cv END)), 2) END, 1) AS fidelity FROM f"""
SQL["judge_prompts"] = """WITH s AS (SELECT row_id, prompt, (constraint_annotations::JSON -> '$.hard_constraints')::VARCHAR[] AS hard FROM samples) SELECT row_id, md5('Rate from 0 to 100 how physically plausible the clip is: ' || prompt || chr(10) || CASE WHEN len(hard) > 0 THEN 'Each of these must hold throughout:' || chr(10) || array_to_string(list_transform(hard, lambda c: '- ' || c), chr(10)) || chr(10) ELSE '' END || '90-100: nothing physically impossible. 70-89: small approximations only. 50-69: one clear, local fault. 25-49: a known law is broken. 0-24: several grave faults. In doubt take the lower band, and look at the last frames for faults that add up.' || chr(10) || 'Answer with one whole number, then a reason.') AS prompt FROM s"""
SQL["token_totals"] = "SELECT event_type AS judge, sum(coalesce(CASE WHEN event_id % 4 <> 0 THEN event_id % 1000 END, 0) + event_id % 77)::BIGINT AS tokens, count(*) AS calls FROM events GROUP BY 1"
SQL["streaming_metrics"] = f"{SCORED} SELECT model_id, count(*) AS n, round(avg(weighted_score), 6) AS relax_score, round(avg(strict::INT::DOUBLE), 6) AS strict_pass_rate, round(avg(weighted_score * gate), 6) AS gated_score FROM scored {DONE} GROUP BY 1"
SQL["user_sessions"] = "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), b AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS started, count(*) AS n FROM b GROUP BY user_id, k"


def steady(sql: str) -> str:
    """``round(x, 5 or 6)`` with a billionth added, so that ties fall alike in both engines."""
    out, i = [], 0
    while (at := sql.find("round(", i)) >= 0:
        if at and (sql[at - 1].isalnum() or sql[at - 1] == "_"):
            out.append(sql[i : at + 6])
            i = at + 6
            continue
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = steady(sql[at + 6 : end - 1])
        body, _, digits = inner.rpartition(",")
        out.append(sql[i:at] + (f"round(({body}) + 1e-9,{digits})" if digits.strip() in ("5", "6") else f"round({inner})"))
        i = end
    return "".join(out) + sql[i:]


SQL = {name: steady(sql) for name, sql in SQL.items()}


# -- kernels and checks of clips ------------------------------------------------------------

PIXELS = VECTORS + """, px AS (SELECT video::BIGINT AS video, frame::BIGINT AS frame, list_transform(vector[1:60], lambda x: greatest(0, least(255, floor(x * 400 + 128.5)::INT))) AS b FROM v),
 grey AS (SELECT video, frame, b, list_transform(range(0, 20), lambda i: round_even(0.114::DOUBLE * b[3 * i + 1] + 0.587::DOUBLE * b[3 * i + 2] + 0.299::DOUBLE * b[3 * i + 3], 0)) AS g FROM px),
 two AS (SELECT *, lag(g) OVER (PARTITION BY video ORDER BY frame) AS g0, lag(b) OVER (PARTITION BY video ORDER BY frame) AS b0 FROM grey)"""


def joint(b: str) -> str:
    """Which of the 64 x 64 x 64 cells each pixel falls into."""
    return f"list_transform(range(0, 20), lambda i: {b}[3 * i + 1] // 4 + 64 * ({b}[3 * i + 2] // 4) + 4096 * ({b}[3 * i + 3] // 4))"


SQL["kernel_dark_background"] = f"{PIXELS} SELECT video, frame, (len(list_filter(g, lambda x: x < 30)) / 20.0::DOUBLE > 0.4)::INT::DOUBLE AS value FROM grey"
SQL["kernel_roi_correlation"] = f"""{PIXELS}, u AS (SELECT video, frame, unnest(g) AS y, unnest(g0) AS x FROM two WHERE g0 IS NOT NULL)
 SELECT video, frame, round(CASE WHEN stddev_pop(x) < 1e-6 OR stddev_pop(y) < 1e-6 THEN 0 ELSE greatest(0.0::DOUBLE, corr(x, y)) END, 6) AS value FROM u GROUP BY 1, 2"""
# Counts of cells as sparse histograms; empty cells enter the correlation by their number.
SQL["kernel_histogram_correlation"] = f"""{PIXELS}, k AS (SELECT video, frame, unnest({joint('b')}) AS cell, 1 AS now FROM two WHERE b0 IS NOT NULL UNION ALL SELECT video, frame, unnest({joint('b0')}), 0 FROM two WHERE b0 IS NOT NULL),
 h AS (SELECT video, frame, cell, sum(1 - now)::DOUBLE AS x, sum(now)::DOUBLE AS y FROM k GROUP BY 1, 2, 3),
 t AS (SELECT video, frame, sum(x * y) - 400.0 / 262144 AS xy, sum(x * x) - 400.0 / 262144 AS xx, sum(y * y) - 400.0 / 262144 AS yy FROM h GROUP BY 1, 2)
 SELECT video, frame, round(xy / sqrt(xx * yy) + 1e-9, 6) AS value FROM t"""
SQL["count_check"] = f"""{FRAMES}, m AS (SELECT video, greatest(1.0, round_even(median(n), 0)) AS nominal FROM fr GROUP BY 1),
 s AS (SELECT video, avg(greatest(0.1::DOUBLE, 1 - 2 * abs(n - nominal) / nominal)) AS mean, max(n) AS most, min(n) AS least, string_agg(n::VARCHAR, ',' ORDER BY frame) AS counts FROM fr JOIN m USING (video) GROUP BY 1)
 SELECT video, round(CASE WHEN most = 0 THEN 0.1 ELSE greatest(0.1::DOUBLE, least(1.0::DOUBLE, mean)) END, 4) AS score, most = least AND most > 0 AS stable, 0.9::DOUBLE AS weight, counts FROM s"""
SQL["merge_check"] = f"{FRAMES}, s AS (SELECT video, avg((n < 2)::INT::DOUBLE) AS f FROM fr GROUP BY 1) SELECT video, round(1 - f, 4) AS score, round(f, 4) AS merge_fraction FROM s"
SQL["trace_check"] = f"""{FRAMES}, p AS (SELECT video, CASE video % 4 WHEN 0 THEN 0 WHEN 1 THEN n ELSE 20 + n * (video % 7) END::DOUBLE AS p FROM fr), s AS (SELECT video, count(*) FILTER (WHERE p > 0) AS n, 100 * stddev_pop(p) FILTER (WHERE p > 0) / (avg(p) FILTER (WHERE p > 0) + 1e-8) AS off FROM p GROUP BY 1)
 SELECT video, CASE WHEN n = 0 THEN 0 WHEN n = 1 THEN 0.5 WHEN off <= 15 THEN 1 WHEN off <= 30 THEN 0.5 ELSE 0 END::DOUBLE AS score FROM s"""
SQL["jacket_check"] = f"""{VECTORS}, q AS (SELECT video, frame, vector[1:2 + (frame % 3) * 2] AS a, lag(vector[1:2 + (frame % 3) * 2]) OVER (PARTITION BY video ORDER BY frame) AS b FROM v),
 c AS (SELECT video, list_sum(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] * b[i])) / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))) AS c FROM q)
 SELECT video, round(coalesce(avg(greatest(0.0::DOUBLE, c)) FILTER (WHERE c IS NOT NULL), 0), 4) AS score FROM c GROUP BY 1"""
SQL["turbine_check"] = f"{FRAMES} SELECT video, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, avg(CASE WHEN n <> 2 THEN value / 100.0::DOUBLE ELSE 0 END))), 4) AS score FROM fr GROUP BY 1"


def coupled(score: str, off: str, rigid: str, enough: str) -> str:
    return f"video, CASE WHEN {enough} THEN round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, {score})), 4) ELSE 0.1::DOUBLE END AS score, CASE WHEN {enough} THEN round({off}, 2) ELSE 100.0::DOUBLE END AS deviation, ({enough}) AND ({rigid}) AS rigid"


SQL["scissor_check"] = f"""{FRAMES}, a AS (SELECT video, frame, CASE video % 5 WHEN 0 THEN CASE WHEN frame = 0 THEN value / 30.0::DOUBLE END WHEN 1 THEN frame * 0.1::DOUBLE WHEN 2 THEN frame * 0.1::DOUBLE + (frame % 2) * 0.008::DOUBLE WHEN 3 THEN 1.0::DOUBLE ELSE value / 30.0::DOUBLE END AS x FROM fr),
 b AS (SELECT *, x - lag(x) OVER (PARTITION BY video ORDER BY frame) AS step FROM a WHERE x IS NOT NULL), c AS (SELECT video, count(*) AS n, bool_and(step >= 0) OR bool_and(step <= 0) AS one, avg(abs(step)) AS mean, stddev_pop(abs(step)) AS sd FROM b GROUP BY 1),
 e AS (SELECT video, n, one, CASE WHEN mean > 1e-3 THEN 100 * sd / (mean + 1e-8) ELSE 0 END AS off FROM c)
 SELECT {coupled("CASE WHEN one AND off < 10 THEN 1.0 WHEN one AND off < 25 THEN 0.5 + 0.4 * (1 - (off - 10) / 15) ELSE 0.1 + 0.4 * greatest(0.0, 1 - off / 100) END", "off", "one AND off < 25", "n >= 2")} FROM e"""
SQL["conveyor_check"] = f"""{FRAMES}, a AS (SELECT video, frame, CASE video % 4 WHEN 0 THEN 3.0::DOUBLE + n * 0.1::DOUBLE WHEN 1 THEN -2.0::DOUBLE - n * 0.5::DOUBLE WHEN 2 THEN value - 20.0::DOUBLE ELSE CASE WHEN frame = 3 THEN -1.0::DOUBLE ELSE 2.0::DOUBLE END END AS x FROM fr),
 b AS (SELECT *, (sign(x) <> sign(lag(x) OVER (PARTITION BY video ORDER BY frame)))::INT AS turn FROM a),
 c AS (SELECT video, coalesce(min(x) >= 0 OR max(x) <= 0, false) OR coalesce(sum(turn), 0) <= 0.15::DOUBLE * count(*) AS steady, 100 * stddev_pop(abs(x)) / (avg(abs(x)) + 1e-8) AS off FROM b GROUP BY 1)
 SELECT {coupled("CASE WHEN steady AND off < 20 THEN 1.0 WHEN steady AND off < 50 THEN 0.5 + 0.4 * (1 - (off - 20) / 30) ELSE 0.1 + 0.3 * greatest(0.0, 1 - off / 100) END", "off", "steady AND off < 50", "true")} FROM c"""
SQL["arm_check"] = f"""{VECTORS}, a AS (SELECT video, frame, list_transform(vector[1:CASE WHEN frame % 4 = 3 THEN 6 WHEN frame % 9 = 8 THEN 1 ELSE 10 END], lambda x: 20.0::DOUBLE + x * (video % 3)) AS d FROM v),
 b AS (SELECT * FROM a WHERE len(d) >= 3), m AS (SELECT video, min(len(d)) AS least, count(*) AS n FROM b GROUP BY 1), l AS (SELECT video, unnest(d) AS x, generate_subscripts(d, 1) AS link FROM b),
 r AS (SELECT video, link, stddev_pop(x) / (avg(x) + 1e-8) AS off FROM l JOIN m USING (video) WHERE link <= least GROUP BY 1, 2), s AS (SELECT video, avg(off) AS off FROM r GROUP BY 1)
 SELECT {coupled("1 - off * 5", "off * 100", "off * 100 < 5", "coalesce(n >= 2, false)")} FROM (SELECT DISTINCT video FROM a) LEFT JOIN m USING (video) LEFT JOIN s USING (video)"""
SQL["chain_check"] = f"""{VECTORS}, a AS (SELECT video, {', '.join(f"avg(greatest(0.0::DOUBLE, vector[{i + 1}]" + (" + CASE WHEN video % 2 = 0 THEN 0.5 ELSE 0 END" if i == 0 else "") + f")) AS b{i}" for i in range(5))} FROM v GROUP BY 1),
 c AS (SELECT *, greatest(b0, b1, b2, b3, b4) AS best FROM a)
 SELECT video, round(CASE WHEN b0 >= 0.3 THEN b0 ELSE best END, 6) AS score, CASE WHEN b0 >= 0.3 OR b0 = best THEN 'default' WHEN b1 = best THEN 'top_30' WHEN b2 = best THEN 'bottom_30' WHEN b3 = best THEN 'left_40' ELSE 'right_40' END AS band FROM c"""
SQL["kernel_bilateral_symmetry"] = f"""{PIXELS}, m AS (SELECT video, frame, 1 - list_avg(list_transform(range(0, 8), lambda i: abs(g[(i // 2) * 5 + i % 2 + 1] - g[(i // 2) * 5 + 5 - i % 2]))) / 255.0::DOUBLE AS v, 1 - list_avg(list_transform(range(0, 10), lambda i: abs(g[i + 1] - g[(3 - i // 5) * 5 + i % 5 + 1]))) / 255.0::DOUBLE AS h FROM grey)
 SELECT video, frame, CASE WHEN greatest(v, h) >= 0.25 THEN round(greatest(v, h), 6) END AS value FROM m"""
ANGLES = MODELS.replace(f"{clean('viewpoint_motion_score')} AS angle", "CASE WHEN result_id % 5 <> 0 THEN (result_id % 700) / 10.0::DOUBLE END AS angle")
SQL["angle_gates"] = f"{ANGLES} SELECT model_id, motion_tier, {r6('rif', 'rif_gated', digits=4)}, rif_note, round(gated_score, 4) AS gated_score FROM metrics"


# -- documents ------------------------------------------------------------------------------


def words_of(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(map(text, R.STOP_TOKENS))})))"


def looked_up(c: str, values: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in values.items()) + " ELSE '' END"


SCENARIO = "trim(regexp_replace(regexp_extract(prompt, 'Core scenario:\\s*(.*?)(\\s+Reference subject:|$)', 1), '\\s+', ' ', 'g'))"
PLAN = f"""WITH {LATEST}, n AS (SELECT image_path, count(*) AS reuse FROM samples WHERE image_path IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT image_path FROM samples WHERE row_id % 3 <> 0 AND image_path IS NOT NULL),
 i AS (SELECT image_path AS item, {words_of("array_to_string(list_reverse(list_reverse(string_split(regexp_replace(image_path, '[.][^.]*$', ''), '/'))[1:3]), ' ')")} AS ws FROM p WHERE regexp_matches(lower(image_path), '[.](jpg|jpeg|png|webp)$')),
 r AS (SELECT task_id, domain, task_category, image_path, video_generation_prompt, coalesce({SCENARIO}, '') AS core_scenario, {looked_up('task_category', R.IMAGE_REQUIREMENTS)} AS requirement, {looked_up('domain', R.SEARCH_WORDS)} AS search FROM latest),
 q AS (SELECT *, trim(core_scenario || ' ' || search || ' ' || replace(coalesce(task_category, ''), '_', ' ') || ' real industrial photo high resolution') AS query_text, {words_of("coalesce(domain, '') || ' ' || coalesce(task_category, '') || ' ' || core_scenario || ' ' || search")} AS ws FROM r),
 c AS (SELECT task_id, item, len(list_intersect(q.ws, i.ws)) + CASE WHEN q.image_path = item THEN 3 ELSE 0 END AS score FROM q, i), f AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, item) AS position FROM c WHERE score > 0),
 l AS (SELECT task_id, string_agg(item, ' | ' ORDER BY position) AS items FROM f WHERE position <= 5 GROUP BY 1),
 plan AS (SELECT q.task_id, domain, task_category, core_scenario, q.image_path AS current_image_path, CASE WHEN p.image_path IS NULL THEN 'no' ELSE 'yes' END AS image_exists, coalesce(reuse, 0) AS current_image_reuse_count, requirement AS image_requirement, query_text AS recommended_search_query, coalesce(items, '') AS local_candidate_images, video_generation_prompt
 FROM q LEFT JOIN n ON q.image_path = n.image_path LEFT JOIN p ON q.image_path = p.image_path LEFT JOIN l ON l.task_id = q.task_id)"""
SQL["sourcing_plan"] = f"{PLAN} SELECT * FROM plan"
SQL["sourcing_review"] = f"{PLAN} SELECT task_id, current_image_reuse_count, image_exists FROM plan WHERE current_image_reuse_count > 1 OR image_exists = 'no'"


def told(name: str, c: str) -> str:
    return f"'- {name}: `' || coalesce(({c})::VARCHAR, '') || '`'"


def numbered(keys: str, lines: list[str], source: str) -> str:
    return f"SELECT {keys}, n::BIGINT - 1 AS line_no, md5(line) AS line FROM (SELECT {keys}, unnest([{', '.join(lines)}]) AS line, unnest(range(1, {len(lines) + 1})) AS n FROM {source}) WHERE line IS NOT NULL"


def fence(c: str) -> list[str]:
    return ["'```text'", f"coalesce({c}, '')", "'```'", "''"]


SQL["sourcing_lines"] = PLAN + " " + numbered("task_id", ["'## `' || task_id || '`'", "''", told("domain", "domain"), told("task_category", "task_category"), told("current_image_path", "current_image_path"), told("current_image_reuse_count", "current_image_reuse_count"), "'- scenario: ' || core_scenario", "'- requirement: ' || image_requirement", told("recommended_search_query", "recommended_search_query"), told("local_candidate_images", "local_candidate_images"), "''", *fence("video_generation_prompt")], "plan WHERE current_image_reuse_count > 1 OR image_exists = 'no'")
SQL["prompt_lines"] = f"""WITH {LATEST}, e AS (SELECT task_id, coalesce(domain, '') AS domain, coalesce(task_category, '') AS task_category, image_path, motion_type, viewpoint_motion_target, coalesce(video_generation_prompt, prompt) AS v, prompt,
 row_number() OVER (PARTITION BY coalesce(domain, '') ORDER BY coalesce(task_category, ''), task_id) AS d, row_number() OVER (PARTITION BY coalesce(domain, ''), coalesce(task_category, '') ORDER BY task_id) AS c FROM latest) """ + numbered(
    "domain, task_category, task_id", ["CASE WHEN d = 1 THEN '## ' || domain END", "CASE WHEN d = 1 THEN '' END", "CASE WHEN c = 1 THEN '### ' || task_category END", "CASE WHEN c = 1 THEN '' END", "'#### `' || task_id || '`'", "''", told("image", "image_path"), told("motion_type", "motion_type"), told("viewpoint_motion_target", "viewpoint_motion_target"), "''", "'Generation prompt:'", "''", *fence("v"), "'Evaluation prompt:'", "''", *fence("prompt")], "e"
)
SQL["audit_lines"] = f"""{SECTIONED}, w AS (SELECT (CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END)::BIGINT AS rank, audit.*, domain, task_category, viewpoint_motion_target, image_path FROM audit JOIN samples USING (row_id) WHERE len(issues) > 0) """.replace("audit.*,", "audit.task_id, audit.row_id, audit.motion, audit.clause, audit.subject, audit.issues, audit.severity,") + numbered(
    "rank, task_id, row_id", ["'### `' || coalesce(task_id, '') || '` — ' || severity", "''", told("domain", "domain"), told("task_category", "task_category"), told("motion_type", "motion"), told("viewpoint_motion_target", "viewpoint_motion_target"), told("reference_subject", "subject"), told("image_path", "image_path"), "'- issues:'", "array_to_string(list_transform(issues, lambda i: '  - ' || i), chr(10))", "'- motion clause:'", *fence("clause")], "w"
)
SQL["audit_document"] = f"""{SECTIONED}, i AS (SELECT unnest(issues) AS issue FROM audit), c AS (SELECT issue || '=' || count(*)::VARCHAR AS x FROM i GROUP BY issue)
 SELECT count(*) AS total_samples, count(*) FILTER (WHERE len(issues) > 0) AS flagged_count, count(*) FILTER (WHERE severity = 'none') AS static, {', '.join(f"count(*) FILTER (WHERE len(issues) > 0 AND severity = '{s}') AS {s}" for s in ('high', 'medium', 'low'))}, (SELECT string_agg(x, ',' ORDER BY x) FROM c) AS issues FROM audit"""
SQL["aggregate_documents"] = f"""{MODELS}, per_domain AS (SELECT model_id, domain, avg(physics) FILTER (WHERE NOT skipped AND has_score) AS p, count(*) AS n FROM scored WHERE domain IS NOT NULL GROUP BY 1, 2),
 in_d AS (SELECT model_id, count(*) AS domains, sum(n)::BIGINT AS in_domains, string_agg(CASE WHEN p IS NOT NULL AND greatest(5.0, p) < 35 THEN domain END, ',' ORDER BY domain) AS physics_low FROM per_domain GROUP BY 1), in_t AS (SELECT model_id, count(*) FILTER (WHERE task_category IS NOT NULL) AS in_tasks FROM scored GROUP BY 1)
 SELECT model_name, round(overall, 4) AS overall, num_samples_completed, motion_tier AS tier, {' + '.join(f'({s} IS NOT NULL)::BIGINT' for s in SHORT)} AS axes, coalesce(domains, 0) AS domains, coalesce(in_domains, 0) AS in_domains, coalesce(in_tasks, 0) AS in_tasks, coalesce(physics_low, '') AS physics_low FROM metrics LEFT JOIN in_d USING (model_id) LEFT JOIN in_t USING (model_id)"""
SQL["report_document"] = f"""{SCORED}, top AS (SELECT model_id FROM sample_results GROUP BY 1 ORDER BY count(*) DESC, model_id LIMIT 1), mine AS (SELECT * FROM scored JOIN top USING (model_id)),
 long AS ({' UNION ALL '.join(f"SELECT {text(AXIS[s])} AS axis, {s} AS score FROM mine WHERE NOT skipped AND {s} IS NOT NULL" for s in SHORT)}), a AS (SELECT axis, avg(score) AS mean, median(score) AS median, count(*) AS n FROM long GROUP BY 1)
 SELECT (SELECT count(*) FROM mine) AS num_samples_total, (SELECT count(*) FROM mine WHERE NOT skipped) AS num_samples_completed, (SELECT count(DISTINCT domain) FROM mine WHERE NOT skipped AND has_score) AS domains, (SELECT axis FROM a ORDER BY mean, axis LIMIT 1) AS weakest, (SELECT result_id FROM mine WHERE NOT skipped ORDER BY weighted_score, result_id LIMIT 1) AS worst, axis, round(mean, 3) AS mean, round(median, 3) AS median, n FROM a"""
SQL["leaderboard_document"] = f"{RANKED} SELECT count(*) OVER () AS num_models, rank, model_name AS model, coalesce(motion_tier, 'unknown') AS viewpoint_motion_tier, num_samples_completed FROM ranked"
SQL["calibration_document"] = f"""WITH c AS ({SQL['difficulty_calibration']}) SELECT count(*) FILTER (WHERE above_target) OVER () AS flags, 10 + CASE WHEN count(*) FILTER (WHERE above_target) OVER () = 0 THEN 1 ELSE count(*) FILTER (WHERE above_target) OVER () END AS console_lines, bucket, round(mean, 2) AS mean_score, n AS n_samples, above_target FROM c"""
SQL["skip_reasons"] = """WITH v AS (SELECT task_id, min(result_id) % 4 AS frames, max(result_id) % 9 = 0 AS failed FROM sample_results WHERE task_id IS NOT NULL GROUP BY 1), s AS (SELECT DISTINCT task_id FROM samples WHERE task_id IS NOT NULL)
 SELECT * FROM (SELECT s.task_id, CASE WHEN v.task_id IS NULL THEN 'video_not_found' WHEN frames = 0 THEN 'empty_video' WHEN failed THEN 'evaluation_error' END AS skip_reason FROM s LEFT JOIN v ON s.task_id = v.task_id) WHERE skip_reason IS NOT NULL"""
SQL["manifest_upsert"] = """SELECT 'images/' || p_partkey || '.jpg' AS local_path, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN (p_size * 100)::VARCHAR END AS curated_width, CASE WHEN p_partkey % 3 = 0 THEN '700' END AS curated_height, NULL::VARCHAR AS curated_bytes,
 CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN least(p_size * 100, 900) < 700 THEN 'removed_too_small' ELSE 'kept' END WHEN p_partkey % 5 = 0 THEN 'kept' END AS curation_status FROM part"""
SQL["completed_counts"] = f"{SCORED} SELECT model_id, count(*) AS ran, count(*) FILTER (WHERE has_score) AS counted FROM scored {DONE} GROUP BY 1"
SQL["task_profile_rest"] = f"""WITH {INFERRED} SELECT row_id, md5(coalesce(nullif(application_value, ''), {looked_up('inferred_task', R.TASK_VALUES)})) AS value, md5({looked_up('inferred_task', R.IMAGE_REQUIREMENTS)}) AS requirement, {looked_up('inferred_task', R.TASK_GATES)} AS gate FROM inferred"""
SQL["judge_context"] = """WITH s AS (SELECT row_id, domain, topology_type, motion_type, (constraint_annotations::JSON -> '$.hard_constraints')::VARCHAR[] AS hard, industrial_logic_questions AS q FROM samples)
 SELECT row_id, md5(concat_ws(chr(10), 'domain: ' || domain, 'topology: ' || topology_type, 'motion: ' || motion_type, CASE WHEN len(hard) > 0 THEN 'hard_constraints: ' || array_to_string(hard[1:8], '; ') END)) AS context,
 md5(array_to_string(list_transform(q, lambda x, i: i::VARCHAR || '. ' || x.text || coalesce(' [target: ' || x.weakness_target || ']', '')), chr(10))) AS questions FROM s"""
OWN = {s: "coalesce(" + ", ".join(f"axis_weights[{text(k)}]" for k in (a, *(k for k, v in R.AXIS_ALIASES.items() if v == a))) + ", 1.0)" for s, a in AXIS.items()}
SQL["sample_weights"] = f"""WITH {INFERRED}, o AS (SELECT inferred.*, row_number() OVER (PARTITION BY task_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) AS nth FROM inferred WHERE task_id IS NOT NULL)
 SELECT task_id, {', '.join(f"CASE WHEN cardinality(axis_weights) > 0 THEN {OWN[s]} ELSE " + weight(s).replace('task_category', 'inferred_task') + f" END::DOUBLE AS w_{s}" for s in SHORT)} FROM o WHERE nth = 1"""
SQL["weighted_by_sample"] = f"""{SCORED}, ws AS ({SQL['sample_weights']}), j AS (SELECT scored.*, {', '.join(f'coalesce(w_{s}, {weight(s)})::DOUBLE AS w_{s}' for s in SHORT)} FROM scored LEFT JOIN ws USING (task_id))
 SELECT result_id, round(coalesce(({' + '.join(f'coalesce({s} * w_{s}, 0)' for s in SHORT)}) / nullif({' + '.join(f'CASE WHEN {s} IS NULL THEN 0 ELSE w_{s} END' for s in SHORT)}, 0), 0) + 1e-9, 6) AS weighted_score FROM j"""
SQL["unknown_fields"] = "SELECT line_id AS record, unnest(list_filter(json_keys(payload), lambda k: k NOT IN ('task_id', 'domain', 'task_category', 'skipped'))) AS path FROM raw_results WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'"
SQL["count_aggregate"] = f"WITH c AS ({SQL['count_check']}), w AS (SELECT score, [0.6, 0.9, 0.95, 0.7][video % 4 + 1]::DOUBLE AS weight FROM c) SELECT round(greatest(0.1::DOUBLE, sum(score * weight) / sum(weight)), 4) AS score FROM w"
