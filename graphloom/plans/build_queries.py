"""Queries over the graph built from the reflection documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import build, graph
from graphloom.plans import tools
from graphloom.plans.pipeline import _NESTED, _unwrapped
from graphloom.session import table


def _built(spark: SparkSession, d: str) -> build.Built:
    return build.build_graph(table(spark, d, "reflections"))


def _graph(spark: SparkSession, d: str) -> graph.Graph:
    b = _built(spark, d)
    return graph.parsed(b.nodes, b.edges)


def build_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).nodes


def build_edges(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).edges


def build_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).warnings.groupBy("code").agg(F.count("*").alias("n"))


def resolve_binding(spark: SparkSession, d: str) -> DataFrame:
    return tools.resolve_binding(_graph(spark, d))


def list_scheduled_tasks(spark: SparkSession, d: str) -> DataFrame:
    return tools.list_scheduled_tasks(_graph(spark, d))


def built_listeners(spark: SparkSession, d: str) -> DataFrame:
    return tools.listeners(_graph(spark, d))


def enclosing_calls(spark: SparkSession, d: str) -> DataFrame:
    """Every call edge's file and line as a reference, resolved to the method it lies in."""
    g = graph.load_graph(spark, d)
    refs = g.edges_of("calls").select("project_slug", "target", F.col("e.file").alias("file"), F.col("e.line").alias("line"), F.col("e.character").alias("character"))
    starts = build.method_starts(graph.unique_nodes(table(spark, d, "nodes")))
    return build.enclosing_calls(refs, starts)


QUERIES = {f.__name__: f for f in (build_nodes, build_edges, build_warnings, resolve_binding, list_scheduled_tasks, built_listeners, enclosing_calls)}

# The entries of the latest readable document of each project; ``document_id`` holds the project.
_CURRENT = f"""
docs AS (
  SELECT project_slug AS document_id, {_unwrapped("j")} AS j FROM (
    SELECT *, row_number() OVER (PARTITION BY project_slug ORDER BY received_at DESC NULLS LAST, document_id DESC) AS n FROM (
      SELECT *, TRY_CAST(ltrim(body, chr(65279)) AS JSON) AS j FROM reflections WHERE project_slug IS NOT NULL)
    WHERE j IS NOT NULL AND starts_with(coalesce(j->>'$.schema_version', '2.'), '2.'))
  WHERE n = 1),
parts AS""" + _NESTED.split("parts AS", 1)[1]

ORACLE = {
    "resolve_binding": f"""
WITH {_CURRENT},
b AS (SELECT * FROM (SELECT *, {_unwrapped("concrete")} AS c, row_number() OVER (PARTITION BY document_id, abstract ORDER BY parent_pos) AS n FROM bindings) WHERE n = 1 AND abstract IS NOT NULL)
SELECT document_id AS project_slug, abstract, CASE json_type(c) WHEN 'VARCHAR' THEN c->>'$' ELSE c->>'$.class' END AS concrete_class, CASE json_type(c) WHEN 'VARCHAR' THEN 'class' ELSE c->>'$.kind' END AS concrete_kind,
       coalesce(TRY_CAST(shared AS BOOLEAN), false) AS shared, CASE WHEN json_type(c) = 'OBJECT' THEN c->>'$.file' END AS file, CASE WHEN json_type(c) = 'OBJECT' THEN TRY_CAST(c->>'$.line' AS INT) END AS line FROM b""",
    "enclosing_calls": """
WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_slug, id ORDER BY kind NULLS FIRST, name NULLS FIRST, attributes NULLS FIRST) AS r FROM nodes) WHERE r = 1),
c AS (SELECT project_slug, id, attributes->>'$.file' AS file FROM n WHERE starts_with(id, 'class:')),
m AS (SELECT n.project_slug, n.id AS method_id, c.file, TRY_CAST(n.attributes->>'$.line' AS INT) AS start_line FROM n JOIN c ON c.project_slug = n.project_slug AND c.id = 'class:' || (n.attributes->>'$.class_fqn') WHERE n.kind = 'method'),
r AS (SELECT edge_seq, project_slug, target, attributes->>'$.file' AS file, TRY_CAST(attributes->>'$.line' AS INT) AS line, TRY_CAST(attributes->>'$.character' AS INT) AS character FROM edges WHERE kind = 'calls'),
f AS (SELECT r.*, max((m.start_line, m.method_id))[2] AS source FROM r JOIN m ON m.project_slug = r.project_slug AND m.file = r.file AND m.start_line <= r.line GROUP BY ALL)
SELECT DISTINCT project_slug, source, target, file, line, character FROM f WHERE source <> target""",
}
