"""Queries for the general data-processing problems (2, 4 and 5) over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import drift, incremental, nested
from graphloom.session import shared_dir, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    changes, runs = table(spark, d, "file_changes"), table(spark, d, "project_meta")
    log = incremental.CommitLog(spark, f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex}")
    source = incremental.FileSource(spark, f"{d}/file_changes.parquet")
    incremental.incremental_run(source, log, seed=lambda: incremental.watermarks(runs, changes), process=lambda df: df.select("change_id"))
    return incremental.committed_output(spark, log)


def p2_watermarks(spark: SparkSession, d: str) -> DataFrame:
    changes, runs = table(spark, d, "file_changes"), table(spark, d, "project_meta")
    return incremental.watermarks(runs, changes).select("project_slug", "run_id", "wm_commit_no")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found_rows(table(spark, d, "reflections"))


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.object_rows(table(spark, d, "reflections"))


def p4_listeners(spark: SparkSession, d: str) -> DataFrame:
    return nested.listener_table(table(spark, d, "reflections")).drop("parent_id", "child_id")


def p4_bindings(spark: SparkSession, d: str) -> DataFrame:
    return nested.binding_table(table(spark, d, "reflections")).drop("child_id")


def p4_cases(spark: SparkSession, d: str) -> DataFrame:
    return nested.case_table(table(spark, d, "reflections")).drop("parent_id", "child_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "meta_files")).select("file_id", "field", "change")


def p5_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return drift.alternatives(table(spark, d, "meta_files"))


def p5_project_meta(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "meta_files"), "project_meta")


def p5_global_config(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "meta_files"), "global_config")


QUERIES = {f.__name__: f for f in (p2_found, p2_watermarks, p4_found, p4_objects, p4_listeners, p4_bindings, p4_cases, p5_found, p5_alternatives, p5_project_meta, p5_global_config)}

_MARKS = """
last AS (
  SELECT project_slug, max_by(run_id, (done, run_id)) AS run_id, max_by(c, (done, run_id)) AS c, max_by(started_at, (done, run_id)) AS started_at
  FROM (SELECT *, lower(trim(last_indexed_commit)) AS c,
               TRY_CAST(CASE WHEN regexp_matches(trim(indexed_at), '([Zz]|[+-][0-9]{2}:?[0-9]{2})$') THEN trim(indexed_at) ELSE trim(indexed_at) || 'Z' END AS TIMESTAMPTZ) AS done
        FROM project_meta WHERE run_status = 'ok')
  WHERE done IS NOT NULL AND c <> '' AND project_slug IS NOT NULL GROUP BY 1),
marks AS (
  SELECT l.project_slug, max(l.run_id) AS run_id, min(f.commit_no) AS wm_commit_no, max(l.started_at) AS wm_started
  FROM last l JOIN (SELECT DISTINCT project_slug, lower(commit_sha) AS sha, commit_no FROM file_changes) f
    ON f.project_slug = l.project_slug AND length(l.c) >= 10 AND starts_with(f.sha, l.c) GROUP BY 1)"""



def _unwrapped(x: str) -> str:
    """SQL for a value that may be JSON text within JSON text."""
    once = lambda v: f"CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches({v}->>'$', '^[\\s\\x{{feff}}]*[\\[{{\"n]') THEN coalesce(TRY_CAST(ltrim({v}->>'$', chr(65279)) AS JSON), {v}) ELSE {v} END"
    return f"(SELECT {once('v1')} FROM (SELECT {once('v0')} AS v1 FROM (SELECT {x} AS v0)))"


def _places(source: str, carried: str, alone: str) -> str:
    """SQL for the entries (pos, key, e) of the containers ``v`` of a table, in any of their spellings."""
    return f"""(
  SELECT {carried}, generate_subscripts(v::JSON[], 1) - 1 AS pos, NULL AS key, unnest(v::JSON[]) AS e FROM {source} WHERE json_type(v) = 'ARRAY'
  UNION ALL
  SELECT {carried}, CASE WHEN numbers THEN TRY_CAST(k AS INT) ELSE list_position(ks, k) - 1 END, CASE WHEN numbers THEN NULL ELSE k END, json_extract(v, '/' || replace(replace(k, '~', '~0'), '/', '~1'))
  FROM (SELECT *, len(list_filter(ks, lambda x: NOT regexp_full_match(x, '[0-9]+') OR TRY_CAST(x AS INT) IS NULL)) = 0 AS numbers, unnest(ks) AS k
        FROM (SELECT *, list_sort(list_distinct(json_keys(v))) AS ks FROM {source} WHERE json_type(v) = 'OBJECT') WHERE NOT list_has_any(ks, {alone}))
  UNION ALL
  SELECT {carried}, 0, NULL, v FROM {source} WHERE json_type(v) NOT IN ('ARRAY', 'NULL') AND (json_type(v) <> 'OBJECT' OR list_has_any(json_keys(v), {alone})))"""


_EVENT, _LISTENER, _BINDING = "['event', 'listeners']", "['kind', 'class', 'method', 'file', 'line', 'queued', 'source']", "['abstract', 'concrete']"
_NESTED = f"""
docs AS (
  SELECT document_id, {_unwrapped("j")} AS j FROM (
    SELECT document_id, TRY_CAST(ltrim(body, chr(65279)) AS JSON) AS j, row_number() OVER (PARTITION BY document_id ORDER BY received_at DESC NULLS LAST, body DESC) AS n FROM reflections)
  WHERE n = 1 AND j IS NOT NULL),
parts AS (SELECT document_id, {_unwrapped("s->'events'")} AS ev, {_unwrapped("s->'bindings'")} AS bi, {_unwrapped("s->'classes'")} AS cl FROM (SELECT document_id, {_unwrapped("j->'sections'")} AS s FROM docs)),
held_events AS (
  SELECT document_id, 'listeners' AS section, {_unwrapped("ev->'listeners'")} AS v FROM parts UNION ALL SELECT document_id, 'wildcards', {_unwrapped("ev->'wildcards'")} FROM parts),
events AS (SELECT document_id, section, pos AS parent_pos, key, {_unwrapped("e")} AS e FROM {_places("held_events", "document_id, section", _EVENT)}),
held_listeners AS (
  SELECT document_id, section, parent_pos, CASE WHEN own THEN coalesce(e->>'$.event', CASE WHEN json_exists(e, '$.event') THEN NULL ELSE key END) ELSE key END AS event, {_unwrapped("CASE WHEN own THEN e->'listeners' ELSE e END")} AS v
  FROM (SELECT *, json_type(e) = 'OBJECT' AND (key IS NULL OR list_has_any(json_keys(e), {_EVENT})) AS own FROM events) WHERE json_type(e) <> 'NULL' AND (own OR key IS NOT NULL OR json_type(e) = 'ARRAY')),
listeners AS (SELECT document_id, section, parent_pos, pos AS child_pos, event, e FROM (SELECT * REPLACE ({_unwrapped("e")} AS e) FROM {_places("held_listeners", "document_id, section, parent_pos, event", _LISTENER)}) WHERE json_type(e) <> 'NULL'),
held_bindings AS (SELECT document_id, {_unwrapped("bi->'bindings'")} AS v FROM parts),
bindings AS (
  SELECT document_id, pos AS parent_pos, CASE WHEN whole THEN coalesce(e->>'$.abstract', key) ELSE key END AS abstract, CASE WHEN whole THEN e->'concrete' ELSE e END AS concrete, CASE WHEN whole THEN e->>'$.shared' END AS shared
  FROM (SELECT *, json_type(e) = 'OBJECT' AND list_has_any(json_keys(e), {_BINDING}) AS whole FROM (SELECT * REPLACE ({_unwrapped("e")} AS e) FROM {_places("held_bindings", "document_id", _BINDING)})) WHERE json_type(e) <> 'NULL'),
held_classes AS (SELECT document_id, {_unwrapped("cl->'items'")} AS v FROM parts),
classes AS (
  SELECT document_id, pos AS parent_pos, key, {_unwrapped("CASE WHEN json_type(r) IS NULL OR json_type(r) = 'NULL' THEN CASE WHEN key IS NOT NULL AND json_exists(e, '$.cases') THEN e END ELSE r END")} AS r
  FROM (SELECT *, {_unwrapped("e->'reflection'")} AS r FROM (SELECT * REPLACE ({_unwrapped("e")} AS e) FROM {_places("held_classes", "document_id", "['source', 'kinds', 'reflection']")})) WHERE json_type(e) <> 'NULL'),
held_cases AS (SELECT document_id, parent_pos, coalesce(r->>'$.name', key) AS class, {_unwrapped("r->'cases'")} AS v FROM classes),
cases AS (
  SELECT document_id, parent_pos, pos AS child_pos, class, key, e FROM (SELECT * REPLACE ({_unwrapped("e")} AS e) FROM {_places("held_cases", "document_id, parent_pos, class", "['name']")})
  WHERE key IS NOT NULL OR json_type(e) <> 'NULL')"""

_TYPE = "CASE json_type({0}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END"
_DRIFT = f"""
once AS (SELECT file_id, r.* FROM (SELECT file_id, arg_min({{'doc_kind': doc_kind, 'stream_key': stream_key, 'written_at': written_at, 'body': body}}, (written_at, doc_kind, stream_key, body)) AS r FROM meta_files GROUP BY 1)),
files AS (
  SELECT *, row_number() OVER (PARTITION BY doc_kind, stream_key ORDER BY written_at, file_id) AS seq
  FROM (SELECT * REPLACE (TRY_CAST(ltrim(body, chr(65279)) AS JSON) AS body) FROM once) WHERE json_type(body) = 'OBJECT'),
top AS (SELECT file_id, doc_kind, stream_key, seq, k, json_extract(body, '/' || replace(replace(k, '~', '~0'), '/', '~1')) AS v FROM (SELECT *, unnest(list_distinct(json_keys(body))) AS k FROM files)),
pairs AS (
  SELECT file_id, doc_kind, stream_key, seq, k AS field, v FROM top WHERE NOT (doc_kind = 'global_config' AND json_type(v) = 'OBJECT' AND len(json_keys(v)) > 0)
  UNION ALL
  SELECT file_id, doc_kind, stream_key, seq, k || '.' || i, json_extract(v, '/' || replace(replace(i, '~', '~0'), '/', '~1')) FROM (
    SELECT *, unnest(list_distinct(json_keys(v))) AS i FROM top WHERE doc_kind = 'global_config' AND json_type(v) = 'OBJECT')),
typed AS (
  SELECT file_id, doc_kind, stream_key, seq, field, CASE WHEN v::VARCHAR IN ('""', '{{}}', '[]') THEN NULL ELSE {_TYPE.format("v")} END AS tag,
         CASE json_type(v) WHEN 'VARCHAR' THEN v->>'$'
              WHEN 'OBJECT' THEN '{{' || array_to_string(list_transform(list_sort(json_keys(v)), lambda x: to_json(x)::VARCHAR || ': ' || json_extract(v, '/' || replace(replace(x, '~', '~0'), '/', '~1'))::VARCHAR), ', ') || '}}'
              WHEN 'ARRAY' THEN '[' || array_to_string((v::JSON[])::VARCHAR[], ', ') || ']' ELSE v::VARCHAR END AS value
  FROM pairs),
gone AS (SELECT n.file_id, b.doc_kind, b.stream_key, n.seq, b.field, b.tag, b.value FROM typed b JOIN files n ON b.doc_kind = n.doc_kind AND b.stream_key = n.stream_key AND b.seq + 1 = n.seq
         ANTI JOIN typed t ON t.file_id = n.file_id AND t.field = b.field),
came AS (SELECT t.* FROM typed t ANTI JOIN typed b ON b.doc_kind = t.doc_kind AND b.stream_key = t.stream_key AND b.seq + 1 = t.seq AND b.field = t.field WHERE t.seq > 1),
turns AS (
  SELECT g.file_id, g.doc_kind, g.stream_key, g.seq, g.field AS old, c.field FROM
    (SELECT *, row_number() OVER (PARTITION BY file_id, value ORDER BY field) AS n FROM gone WHERE tag IS NOT NULL) g
    JOIN (SELECT *, row_number() OVER (PARTITION BY file_id, value ORDER BY field) AS n FROM came WHERE tag IS NOT NULL) c USING (file_id, value, n))"""

ORACLE = {
    "p2_found": f"""
WITH {_MARKS},
firsts AS (SELECT change_id, min(project_slug) AS project_slug, max(commit_no) AS commit_no, min(received_at) AS received FROM file_changes GROUP BY 1)
SELECT change_id FROM firsts LEFT JOIN marks USING (project_slug)
WHERE NOT coalesce(commit_no <= wm_commit_no AND received <= wm_started, false)""",
    "p4_found": f"""
WITH {_NESTED}
SELECT document_id, section, parent_pos::INT AS parent_pos, child_pos::INT AS child_pos FROM listeners
UNION ALL SELECT document_id, 'bindings', parent_pos::INT, 0 FROM bindings
UNION ALL SELECT document_id, 'cases', parent_pos::INT, child_pos::INT FROM cases""",
    "p4_listeners": f"""
WITH {_NESTED}, l AS (SELECT *, CASE WHEN json_type(e) = 'VARCHAR' THEN e->>'$' END AS plain FROM listeners)
SELECT document_id, section, parent_pos::INT AS parent_pos, child_pos::INT AS child_pos, event, coalesce(e->>'$.kind', CASE WHEN plain IS NOT NULL THEN 'class' END) AS kind,
       coalesce(e->>'$.class', split_part(plain, '@', 1)) AS class, coalesce(e->>'$.method', nullif(split_part(plain, '@', 2), '')) AS method, e->>'$.file' AS file,
       TRY_CAST(e->>'$.line' AS INT) AS line, TRY_CAST(e->>'$.queued' AS BOOLEAN) AS queued, e->>'$.source' AS source FROM l""",
    "p4_bindings": f"""
WITH {_NESTED}, b AS (SELECT *, json_type(concrete) = 'OBJECT' AS whole FROM bindings)
SELECT document_id, parent_pos::INT AS parent_pos, abstract, TRY_CAST(shared AS BOOLEAN) AS shared, CASE WHEN whole THEN concrete->>'$.kind' WHEN concrete->>'$' IS NOT NULL THEN 'class' END AS concrete_kind,
       CASE WHEN whole THEN concrete->>'$.class' ELSE concrete->>'$' END AS concrete_class, CASE WHEN whole THEN concrete->>'$.file' END AS concrete_file, TRY_CAST(CASE WHEN whole THEN concrete->>'$.line' END AS INT) AS concrete_line FROM b""",
    "p4_cases": f"""
WITH {_NESTED},
c AS (SELECT *, CASE WHEN key IS NOT NULL AND json_type(e) <> 'OBJECT' THEN e ELSE e->'value' END AS v FROM cases)
SELECT document_id, parent_pos::INT AS parent_pos, child_pos::INT AS child_pos, class, coalesce(CASE WHEN json_type(e) = 'OBJECT' THEN e->>'$.name' END, key, CASE WHEN json_type(e) = 'VARCHAR' THEN e->>'$' END) AS case_name,
       v->>'$' AS case_value, CASE WHEN json_type(v) IN ('VARCHAR', 'BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN {_TYPE.format("v")} END AS value_type FROM c""",
    "p5_found": f"""
WITH RECURSIVE {_DRIFT},
steps AS (SELECT t.*, CASE WHEN t.seq > 1 THEN coalesce(u.old, t.field) END AS source FROM typed t LEFT JOIN turns u ON u.file_id = t.file_id AND u.field = t.field),
lines AS (
  SELECT s.file_id, s.doc_kind, s.stream_key, s.seq, s.field, s.tag, s.seq AS first_seq, s.field AS first_field FROM steps s
  WHERE NOT EXISTS (SELECT 1 FROM typed b WHERE b.doc_kind = s.doc_kind AND b.stream_key = s.stream_key AND b.seq + 1 = s.seq AND b.field = s.source)
  UNION ALL
  SELECT s.file_id, s.doc_kind, s.stream_key, s.seq, s.field, s.tag, l.first_seq, l.first_field FROM steps s
  JOIN lines l ON l.doc_kind = s.doc_kind AND l.stream_key = s.stream_key AND l.seq + 1 = s.seq AND l.field = s.source),
known AS (SELECT *, last_value(tag IGNORE NULLS) OVER (PARTITION BY doc_kind, stream_key, first_seq, first_field ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lines)
SELECT file_id, field, 'retyped' AS change FROM known WHERE tag <> before
UNION ALL SELECT file_id, field, 'renamed' FROM turns
UNION ALL SELECT file_id, field, 'added' FROM came ANTI JOIN turns USING (file_id, field)
UNION ALL SELECT file_id, field, 'removed' FROM gone ANTI JOIN (SELECT file_id, old AS field FROM turns) USING (file_id, field)""",
    "p2_watermarks": f"WITH {_MARKS} SELECT project_slug, run_id, wm_commit_no FROM marks",
}
