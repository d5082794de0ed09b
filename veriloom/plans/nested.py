"""Queries of problem 4: trajectory_raw.raw as structural-variant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriloom.operators.variants import transitions, variant_nodes, variant_tables
from veriloom.sources.tables import latest_delivery, load


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    raw = load(spark, d, "trajectory_raw", "record_id", "raw", "arrived_at")
    return variant_tables(variant_nodes(latest_delivery(raw, "record_id")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["steps"].select("record_id", "state_path", "round_no", "step_no")


def p4_steps(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["steps"].drop("variant", "extra")


def p4_rounds(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["rounds"].select("record_id", "state_path", "round_no")


def p4_states(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["states"].select("record_id", "state_path", "parent_path", "process_id")


def p4_refs(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["refs"].drop("variant", "extra")


def p4_variants(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "trajectory_raw", "record_id", "raw", "arrived_at")
    return transitions(variant_nodes(latest_delivery(raw, "record_id")))


QUERIES = {"p4_found": p4_found, "p4_steps": p4_steps, "p4_rounds": p4_rounds, "p4_states": p4_states, "p4_refs": p4_refs, "p4_variants": p4_variants}
_STEPS = """WITH RECURSIVE t AS (SELECT record_id, arg_max(raw, arrived_at) AS raw FROM trajectory_raw GROUP BY 1),
s AS (SELECT record_id, '' AS path, raw::JSON AS j FROM t WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'
  UNION ALL SELECT record_id, path || '/' || (k - 1), p[k] FROM (SELECT record_id, path, json_extract(j, '$.prior_fail_try[*]') AS p, unnest(range(1, len(p) + 1)) AS k FROM s WHERE json_type(j, '$.prior_fail_try') = 'ARRAY') WHERE json_type(p[k]) = 'OBJECT'),
l AS (SELECT record_id, path, CASE json_type(j, '$.response_struct') WHEN 'ARRAY' THEN json_extract(j, '$.response_struct[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.response_struct')] ELSE [] END AS rs FROM s),
r AS (SELECT record_id, path, unnest(range(0, len(rs))) AS round_no, unnest(rs) AS x FROM l),
b AS (SELECT record_id, path, round_no, CASE WHEN json_type(x) = 'OBJECT' AND json_exists(x, '$.CoT') THEN x -> '$.CoT'
  WHEN json_type(x) = 'ARRAY' OR json_type(x) = 'OBJECT' AND (json_exists(x, '$.action') OR json_exists(x, '$.title') OR json_exists(x, '$.content')) THEN x END AS body FROM r),
c AS (SELECT record_id, path, round_no, CASE WHEN json_type(body) = 'VARCHAR' AND json_valid(body ->> '$') THEN (body ->> '$')::JSON ELSE body END AS body FROM b),
e AS (SELECT record_id, path, round_no, CASE json_type(body) WHEN 'ARRAY' THEN json_extract(body, '$[*]') WHEN 'OBJECT' THEN [body] ELSE [] END AS es FROM c),
f AS (SELECT record_id, path, round_no, unnest(range(0, len(es))) AS step_no, unnest(es) AS x FROM e)"""

_TEXT = lambda k: f"CASE json_type(x, '$.{k}') WHEN 'VARCHAR' THEN x ->> '$.{k}' WHEN 'NULL' THEN NULL ELSE (x -> '$.{k}')::VARCHAR END AS {k}"

ORACLE = {
    "p4_steps": f"{_STEPS} SELECT record_id, path AS state_path, round_no::INT AS round_no, step_no::INT AS step_no, {_TEXT('action')}, {_TEXT('title')}, json_exists(x, '$.title') AS has_title, {_TEXT('content')} FROM f WHERE json_type(x) <> 'NULL'",
    "p4_rounds": f"{_STEPS} SELECT record_id, path AS state_path, round_no::INT AS round_no FROM r",
    "p4_refs": f"{_STEPS}, h AS (SELECT *, json_extract(x, '$.refs[*]') AS rs FROM f WHERE json_type(x, '$.refs') = 'ARRAY'), i AS (SELECT record_id, path, round_no, step_no, unnest(range(0, len(rs))) AS ref_no, unnest(rs) AS x FROM h) SELECT record_id, path AS state_path, round_no::INT AS round_no, step_no::INT AS step_no, ref_no::INT AS ref_no, x ->> '$.kind' AS ref_kind, x ->> '$.name' AS ref_name FROM i WHERE json_type(x) <> 'NULL'",
    "p4_found": f"{_STEPS} SELECT record_id, path AS state_path, round_no::INT AS round_no, step_no::INT AS step_no FROM f WHERE json_type(x) <> 'NULL'",
    "p4_states": f"{_STEPS} SELECT record_id, path AS state_path, CASE WHEN path <> '' THEN regexp_replace(path, '/[0-9]+$', '') END AS parent_path, (j ->> '$.process_id')::BIGINT AS process_id FROM s",
}
