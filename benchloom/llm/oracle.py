"""DuckDB counterparts of the llm queries that SQL can express."""

from __future__ import annotations


def squash(c: str) -> str:
    return f"nullif(regexp_replace(lower(trim({c})), '[\\s_-]+', '', 'g'), '')"


def canonical(field: str, c: str, name: str = "canon") -> str:
    return f"coalesce((SELECT min({name}) FROM names WHERE names.field_name = '{field}' AND names.key = {squash(c)}), {squash(c)})"


NAMES = f"names AS (SELECT DISTINCT field_name, {squash('alias')} AS key, {squash('canonical')} AS canon, canonical AS plain FROM category_aliases UNION SELECT DISTINCT field_name, {squash('canonical')}, {squash('canonical')}, canonical FROM category_aliases)"

P3 = f"""WITH {NAMES}, s AS (SELECT row_id, task_id, {canonical('domain', 'domain')} AS d, {canonical('task_category', 'task_category')} AS c, difficulty_profile AS p FROM samples WHERE task_id IS NOT NULL),
 l AS (SELECT row_id, {canonical('axis', 'k')} AS a, {squash('v')} AS v FROM (SELECT row_id, unnest(map_keys(p)) AS k, unnest(map_values(p)) AS v FROM s)),
 q AS (SELECT plan_id, cell_id, plan_size, target_share, min_count, {canonical('domain', 'domain')} AS d, {canonical('task_category', 'task_category')} AS c, {canonical('axis', 'difficulty_axis')} AS a, {squash('difficulty')} AS v FROM sampling_plans),
 flat AS (SELECT q.plan_id, q.cell_id, s.task_id FROM q JOIN s ON (q.d IS NULL OR q.d = s.d) AND (q.c IS NULL OR q.c = s.c) WHERE q.v IS NULL UNION ALL
 SELECT q.plan_id, q.cell_id, s.task_id FROM q JOIN l ON q.a = l.a AND q.v = l.v JOIN s ON s.row_id = l.row_id AND (q.d IS NULL OR q.d = s.d) AND (q.c IS NULL OR q.c = s.c) WHERE q.v IS NOT NULL),
 n AS (SELECT plan_id, cell_id, count(DISTINCT task_id) AS n FROM flat GROUP BY 1, 2)
 SELECT plan_id, cell_id FROM q LEFT JOIN n USING (plan_id, cell_id) WHERE coalesce(n, 0) < min_count OR coalesce(n, 0) < round(target_share * plan_size, 6)"""

#: The whole report: seats are the smallest priorities, minimum counts first.
P3_REPORT = P3[: P3.index(" n AS (SELECT plan_id")] + """ m AS (SELECT DISTINCT * FROM flat), z AS (SELECT q.*, greatest(min_count::DOUBLE, round(target_share * plan_size, 6)) AS needed FROM q),
 n AS (SELECT plan_id, cell_id, count(*) AS n FROM m GROUP BY 1, 2), v AS (SELECT z.*, coalesce(n, 0) AS n, least(coalesce(n, 0), greatest(plan_size, ceil(needed)))::BIGINT AS available FROM z LEFT JOIN n USING (plan_id, cell_id)),
 one AS (SELECT plan_id, task_id, arg_min(m.cell_id, (available / greatest(needed, 1e-9), m.cell_id)) AS cell_id FROM m JOIN v USING (plan_id, cell_id) GROUP BY 1, 2), own AS (SELECT plan_id, cell_id, count(*) AS own FROM one GROUP BY 1, 2),
 h AS (SELECT v.*, coalesce(own, 0) AS own, least(min_count, coalesce(own, 0)) AS floor_, sum(least(min_count, coalesce(own, 0))) OVER (PARTITION BY plan_id) >= plan_size AS full_ FROM v LEFT JOIN own USING (plan_id, cell_id)),
 r AS (SELECT plan_id, cell_id, plan_size, target_share, CASE WHEN full_ THEN 0 ELSE floor_ END AS floor_, unnest(range(1, CASE WHEN full_ THEN floor_ ELSE least(own, plan_size) END + 1)) AS r FROM h),
 o AS (SELECT plan_id, cell_id, plan_size, row_number() OVER (PARTITION BY plan_id ORDER BY r > floor_, (r - 0.5) / nullif(target_share, 0), cell_id) AS nth FROM r WHERE r <= floor_ OR target_share > 0),
 s2 AS (SELECT plan_id, cell_id, count(*) AS seats FROM o WHERE nth <= plan_size GROUP BY 1, 2), g AS (SELECT h.*, coalesce(seats, 0) AS seats FROM h LEFT JOIN s2 USING (plan_id, cell_id))
 SELECT plan_id, cell_id, target_share, min_count, needed, available, seats, seats / nullif(sum(seats) OVER (PARTITION BY plan_id), 0)::DOUBLE AS share_reached, n < min_count OR n < round(target_share * plan_size, 6) AS short FROM g"""

P4 = """WITH t AS (SELECT row_id, 'prompt' AS f, prompt AS x FROM samples UNION ALL SELECT row_id, 'video_generation_prompt', video_generation_prompt FROM samples),
 w AS (SELECT row_id, f, list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')) AS ws FROM t WHERE length(x) >= 50), e AS (SELECT row_id, f, len(ws) AS n, unnest(ws) AS word FROM w),
 i AS (SELECT a.row_id AS row_a, b.row_id AS row_b, a.f AS field_name, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.f = b.f AND a.word = b.word AND a.row_id < b.row_id GROUP BY 1, 2, 3)
 SELECT row_a, row_b, field_name FROM i WHERE c * 10 >= 7 * (na + nb - c)"""

P2 = f"""WITH {NAMES}, v AS (SELECT *, scored.weighted_score AS value FROM sample_results WHERE scored.weighted_score IS NOT NULL AND NOT isnan(scored.weighted_score) AND NOT isinf(scored.weighted_score) AND scored.weighted_score <> -1),
 one AS (SELECT *, row_number() OVER (PARTITION BY model_id, task_id, run_at, CASE WHEN model_id IS NULL OR task_id IS NULL OR run_at IS NULL THEN result_id END ORDER BY ingested_at DESC NULLS LAST, result_id DESC) AS nth FROM v)
 SELECT {canonical('domain', 'domain', 'plain')} AS domain, {canonical('task_category', 'task_category', 'plain')} AS task_category, count(*) AS n, min(value) AS least, max(value) AS most FROM one WHERE nth = 1 GROUP BY 1, 2"""

P4_GROUPS = """WITH RECURSIVE t AS (SELECT row_id, 'prompt' AS f, prompt AS x FROM samples UNION ALL SELECT row_id, 'video_generation_prompt', video_generation_prompt FROM samples),
 w AS (SELECT row_id, f, list_sort(list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+'))) AS ws FROM t WHERE length(x) >= 50), r AS (SELECT row_id, f, ws, min(row_id) OVER (PARTITION BY f, ws) AS rec, count(*) OVER (PARTITION BY f, ws) AS copies FROM w WHERE len(ws) > 0),
 e AS (SELECT rec, f, len(ws) AS n, unnest(ws) AS word FROM r WHERE row_id = rec), i AS (SELECT a.f, a.rec AS a, b.rec AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.f = b.f AND a.word = b.word AND a.rec <> b.rec GROUP BY 1, 2, 3),
 p AS (SELECT f, a, b FROM i WHERE c * 10 >= 7 * (na + nb - c)), reach AS (SELECT f, a AS origin, a AS here FROM p UNION SELECT reach.f, origin, b FROM reach JOIN p ON p.f = reach.f AND p.a = reach.here),
 k AS (SELECT f, origin, min(here) AS class_id FROM reach GROUP BY 1, 2), d AS (SELECT f, a, count(*) AS near FROM p GROUP BY 1, 2)
 SELECT row_id, r.f AS field_name, coalesce(class_id, rec) AS class_id, coalesce(near, 0) + copies - 1 AS links FROM r LEFT JOIN k ON k.f = r.f AND k.origin = r.rec LEFT JOIN d ON d.f = r.f AND d.a = r.rec"""

SQL = {"p2_totals": P2, "p3_found": P3, "p3_report": P3_REPORT, "p4_found": P4, "p4_groups": P4_GROUPS}
