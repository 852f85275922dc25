"""Queries of the general training-data problems (1 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.operators import drift, units
from benchloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.found(table(spark, sf_dir, "samples"), table(spark, sf_dir, "annotation_sources"))


def p1_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target with a magnitude in the common unit, and where its unit came from."""
    return units.harmonise(table(spark, sf_dir, "samples"), table(spark, sf_dir, "annotation_sources"))


def _drift(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "raw_results"), table(spark, sf_dir, "result_files"), table(spark, sf_dir, "field_aliases")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.found(*_drift(spark, sf_dir))


def p5_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole edit script of every file, nested fields and moves included."""
    return drift.scripts(drift.file_schemas(*_drift(spark, sf_dir)))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all files under one schema."""
    return drift.consistent_table(*_drift(spark, sf_dir))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the consistent table, one row a line and column."""
    rows = drift.consistent_table(*_drift(spark, sf_dir))
    columns = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in drift.NUMERIC))
    return rows.select("line_id", F.inline(columns)).where(F.col("value").isNotNull())


QUERIES = {f.__name__: f for f in (p1_found, p1_targets, p5_found, p5_scripts, p5_table, p5_values)}

#: The changes of top-level fields, by windows over JSON keys.
P5_SQL = """WITH lines AS (SELECT file_id, payload AS p FROM raw_results WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), keys AS (SELECT DISTINCT file_id, k, json_type(p, '$."' || k || '"') AS t FROM (SELECT file_id, p, unnest(json_keys(p)) AS k FROM lines)),
 names AS (SELECT regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') AS key, canonical FROM field_aliases UNION SELECT regexp_replace(lower(canonical), '[^a-z0-9]', '', 'g'), canonical FROM field_aliases),
 fields AS (SELECT file_id, coalesce(canonical, k) AS field, string_agg(DISTINCT k, '|' ORDER BY k) AS written, string_agg(DISTINCT CASE WHEN t IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN 'number' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'NULL' THEN NULL ELSE lower(t) END, '|') AS kind FROM keys LEFT JOIN names ON key = regexp_replace(lower(k), '[^a-z0-9]', '', 'g') GROUP BY 1, 2),
 placed AS (SELECT file_id, stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY file_seq, file_id) AS pos FROM result_files),
 runs AS (SELECT f.*, stream_id, pos, pos - row_number() OVER (PARTITION BY stream_id, field ORDER BY pos) AS run FROM fields f JOIN placed USING (file_id) WHERE field NOT IN ('task_id', 'domain', 'task_category')),
 known AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY stream_id, field, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(written) OVER (PARTITION BY stream_id, field, run ORDER BY pos) AS old, row_number() OVER (PARTITION BY stream_id, field, run ORDER BY pos) AS nth FROM runs)
 SELECT file_id, field AS field_name, 'added' AS change_kind FROM known WHERE nth = 1 AND pos > 1 UNION ALL SELECT file_id, field, 'renamed' FROM known WHERE nth > 1 AND written <> old UNION ALL SELECT file_id, field, 'retyped' FROM known WHERE kind <> before UNION ALL
 SELECT placed.file_id, r.field, 'removed' FROM runs r JOIN placed ON placed.stream_id = r.stream_id AND placed.pos = r.pos + 1 WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.stream_id = r.stream_id AND o.field = r.field AND o.pos = r.pos + 1)"""
#: The numbers of each line, by its names alone.
P5_VALUES = f"""WITH lines AS (SELECT line_id, payload AS p FROM raw_results WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), keys AS (SELECT line_id, k, json_extract(p, '$."' || k || '"') AS v FROM (SELECT line_id, p, unnest(json_keys(p)) AS k FROM lines)),
 names AS (SELECT regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') AS key, canonical FROM field_aliases UNION SELECT regexp_replace(lower(canonical), '[^a-z0-9]', '', 'g'), canonical FROM field_aliases UNION SELECT regexp_replace(x, '_', '', 'g'), x FROM (VALUES {', '.join(f"('{c}')" for c in drift.NUMERIC)}) AS t(x)),
 named AS (SELECT line_id, canonical AS field_name, k, v, json_type(v) AS t, row_number() OVER (PARTITION BY line_id, canonical ORDER BY (json_type(v) = 'NULL'), k) AS nth FROM keys JOIN names ON key = regexp_replace(lower(k), '[^a-z0-9]', '', 'g')),
 typed AS (SELECT line_id, field_name, CASE WHEN t IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN v::DOUBLE WHEN t = 'VARCHAR' THEN try_cast(v->>'$' AS DOUBLE) WHEN t = 'OBJECT' THEN try_cast(v->>'$.value' AS DOUBLE) END AS value FROM named WHERE nth = 1 AND field_name IN ({', '.join(f"'{c}'" for c in drift.NUMERIC)}))
 SELECT line_id, field_name, value FROM typed WHERE value IS NOT NULL"""
ORACLE_SQL = {"p5_found": P5_SQL, "p5_values": P5_VALUES}
