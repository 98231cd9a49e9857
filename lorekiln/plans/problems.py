"""Queries of the general problems (hierarchies, nested records) and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.operators import hierarchy, shred
from lorekiln.sources.tables import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf, "ontology_entry")).drop("descendants")


def p3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    _, ranges, _ = hierarchy.forest(table(spark, sf, "ontology_entry"))
    return hierarchy.descendants(ranges)


def p3_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Per root (or cycle) and status: members and greatest depth."""
    found = hierarchy.hierarchy(table(spark, sf, "ontology_entry"))
    return found.groupBy("root_id", "link_status").agg(F.count("*").alias("members"), F.max("tree_depth").alias("greatest_depth"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return shred.element_links(shred.shred(table(spark, sf, "trace_event")))


def p5_spans(spark: SparkSession, sf: str) -> DataFrame:
    return shred.entity_table(shred.shred(table(spark, sf, "trace_event")), "spans", ["lo", "hi", "precision"])


def p5_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return shred.entity_table(shred.shred(table(spark, sf, "trace_event")), "diagnostics", ["code", "severity"])


def p5_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The flat tables of all entities, payloads included."""
    return shred.entities(shred.shred(table(spark, sf, "trace_event")))


def p5_scalar_elements(spark: SparkSession, sf: str) -> DataFrame:
    return shred.scalar_elements(shred.shred(table(spark, sf, "trace_event")))


def p5_parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    return shred.parse_errors(table(spark, sf, "trace_event"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_descendants, p3_trees, p5_found, p5_spans, p5_diagnostics, p5_entities, p5_scalar_elements, p5_parse_errors)}


CHAINS = r"""
WITH RECURSIVE clean AS (
  SELECT nullif(regexp_replace(id, '^\s+|\s+$', '', 'g'), '') AS id, nullif(regexp_replace(parent, '^\s+|\s+$', '', 'g'), '') AS parent, revision, ingested_at
  FROM ontology_entry
), links AS (
  SELECT id, parent FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC NULLS LAST, ingested_at DESC NULLS LAST, parent DESC NULLS LAST) AS k FROM clean WHERE id IS NOT NULL)
  WHERE k = 1
), chain AS (
  SELECT id, id AS here, [id] AS steps, false AS looped FROM links
  UNION ALL
  SELECT c.id, l.parent, list_append(c.steps, l.parent), list_contains(c.steps, l.parent)
  FROM chain c JOIN links l ON l.id = c.here JOIN links p ON p.id = l.parent WHERE NOT c.looped
), last AS (
  SELECT c.*, l.parent AS beyond FROM chain c JOIN links l ON l.id = c.here
  QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY len(steps) DESC) = 1
)"""

FOUND = (
    CHAINS
    + """
SELECT id,
  CASE WHEN looped THEN CASE WHEN here = id THEN 'cycle' ELSE 'into_cycle' END WHEN beyond IS NULL THEN 'tree' ELSE 'orphan' END AS link_status,
  CASE WHEN looped THEN list_min(list_slice(steps, list_position(steps, here), len(steps))) ELSE here END AS root_id,
  CASE WHEN looped THEN -1 ELSE len(steps) - 1 END::INT AS tree_depth,
  CASE WHEN looped THEN '' ELSE list_aggregate(list_reverse(steps), 'string_agg', '>') END AS tree_path
FROM last"""
)


def _once(source: str, n: int) -> str:
    """One round of reading a string as the JSON it holds (``unwrap``), for DuckDB."""
    s = f"json_extract_string(w{n-1}, '$')"
    objects = f"(trim({s}) LIKE '[{{%' AND list_bool_and(list_transform(range(json_array_length({s}::JSON)::BIGINT), lambda i: json_type(json_extract({s}::JSON, '$[' || i || ']')) = 'OBJECT')))"
    return f"(SELECT *, CASE WHEN json_type(w{n-1}) = 'VARCHAR' AND label <> 'text' AND substr(trim({s}), 1, 1) IN ('{{', '[', '\"') AND json_valid({s}) THEN CASE WHEN trim({s}) LIKE '[%' AND NOT {objects} THEN w{n-1} ELSE {s}::JSON END ELSE w{n-1} END AS w{n} FROM {source})"
def _unwrapped(source: str) -> str:
    for n in (1, 2, 3):
        source = _once(source, n)
    return source


SHREDDED = rf"""
WITH RECURSIVE current_event AS (
  SELECT event_id, nullif(trim(run_id), '') AS run_id, stage, payload FROM trace_event WHERE event_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC NULLS LAST, run_id DESC NULLS LAST, stage DESC NULLS LAST, payload DESC NULLS LAST) = 1
), raw AS (
  SELECT event_id, run_id, stage, w3 AS v, label, NULL::BIGINT AS ordinal, '' AS around, '$' AS key, NULL::VARCHAR AS up
  FROM {_unwrapped("(SELECT event_id, run_id, stage, payload::JSON AS w0, '' AS label FROM current_event WHERE json_valid(payload))")}
  UNION ALL
  SELECT event_id, run_id, stage, w3, label, ordinal, around, up || CASE WHEN ordinal IS NULL THEN '.' || label ELSE '[' || ordinal || ']' END, up
  FROM {_unwrapped('''(SELECT event_id, run_id, stage, up, c.w AS w0, c.label, c.ordinal, c.around FROM (
      SELECT event_id, run_id, stage, key AS up, unnest(CASE json_type(v)
        WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {'w': json_extract(v, '$."' || k || '"'), 'label': k, 'ordinal': NULL::BIGINT, 'around': label})
        ELSE list_transform(range(json_array_length(v)::BIGINT), lambda i: {'w': json_extract(v, '$[' || i || ']'), 'label': label, 'ordinal': i, 'around': around}) END) AS c
      FROM raw WHERE json_type(v) IN ('OBJECT', 'ARRAY')))''')}
), bare AS (
  SELECT around, label FROM raw WHERE ordinal IS NULL AND label <> '' GROUP BY ALL HAVING bool_or(json_type(v) = 'ARRAY') AND bool_or(json_type(v) = 'OBJECT')
), typed AS MATERIALIZED (
  SELECT r.*, json_type(v) AS kind, json_type(v) = 'OBJECT' AND (ordinal IS NOT NULL OR b.label IS NOT NULL) AS element,
    CASE WHEN up IS NULL THEN '$' WHEN ordinal IS NULL THEN '.' || r.label || CASE WHEN json_type(v) = 'OBJECT' AND b.label IS NOT NULL THEN '[0]' ELSE '' END ELSE '[' || ordinal || ']' END AS seg
  FROM raw r LEFT JOIN bare b ON b.around = r.around AND b.label = r.label AND r.ordinal IS NULL
), nodes AS (
  SELECT event_id, run_id, stage, key, label, kind, element, seg AS path, '$' AS owner, '$' AS head, '' AS below, v FROM typed WHERE up IS NULL
  UNION ALL
  SELECT t.event_id, t.run_id, t.stage, t.key, t.label, t.kind, t.element, n.path || t.seg, n.head, CASE WHEN t.element THEN n.path || t.seg ELSE n.head END, CASE WHEN t.element THEN '' ELSE n.below || CASE WHEN t.ordinal IS NULL THEN '.' || t.label ELSE '[]' END END, t.v
  FROM nodes n JOIN typed t ON t.event_id = n.event_id AND t.up = n.key WHERE t.kind IN ('OBJECT', 'ARRAY')
)"""

def _flat(label: str, columns: list[str]) -> str:
    value = ", ".join(f"CASE WHEN json_type(v, '$.{c}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(v, '$.{c}') END AS {c}" for c in columns)
    return f"{SHREDDED} SELECT event_id, run_id, stage, owner AS parent_path, path AS child_path, {value} FROM nodes WHERE element AND label = '{label}'"


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"{SHREDDED} SELECT event_id, owner AS parent_path, path AS child_path FROM nodes WHERE element",
        "p5_spans": _flat("spans", ["lo", "hi", "precision"]),
        "p5_diagnostics": _flat("diagnostics", ["code", "severity"]),
        "p5_scalar_elements": f"""{SHREDDED} SELECT t.event_id, t.run_id, t.stage, n.head AS parent_path, n.path || t.seg AS child_path, ltrim(n.below || '[]', '.') AS field, t.ordinal::INT AS ordinal,
      json_extract_string(t.v, '$') AS value FROM typed t JOIN nodes n ON n.event_id = t.event_id AND n.key = t.up WHERE t.ordinal IS NOT NULL AND t.kind NOT IN ('OBJECT', 'ARRAY')""",
        "p5_parse_errors": f"""{SHREDDED} SELECT event_id, run_id, stage, CASE WHEN trim(coalesce(payload, '')) = '' THEN 'Missing' ELSE 'Broken' END AS error
      FROM current_event WHERE NOT coalesce(json_valid(payload), false)""",
        "p3_found": FOUND,
        "p3_trees": f"SELECT root_id, link_status, count(*) AS members, max(tree_depth) AS greatest_depth FROM ({FOUND}) GROUP BY ALL",
        "p3_descendants": CHAINS
        + """
SELECT unnest(list_slice(steps, 2, len(steps))) AS ancestor, id AS descendant, unnest(range(1, len(steps)))::BIGINT AS distance
FROM last WHERE NOT looped AND len(steps) > 1""",
    }
