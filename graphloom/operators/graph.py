"""The typed property graph as two DataFrames, and the primitives every query is made of.

Nodes are keyed by (project_slug, id), edges keep their order in ``edge_seq``; targets may dangle. Attributes are JSON text,
parsed once into a struct. Every operator answers for all subjects at once; a question about one of them is a filter on the
result, which reaches the scans.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import materialize, table

KEY = ["project_slug", "id"]

#: Attributes the queries read, by type. A value of another type reads as null, as does ``[]`` for a map.
NODE_ATTRIBUTES = """
fqn string, namespace string, file string, abstract boolean, final boolean, readonly boolean, source string, kinds array<string>,
cases array<struct<name: string, value: string>>, interfaces_inherited array<string>, class_fqn string, visibility string, static boolean,
return_type string, line int, uri string, methods array<string>, name string, domain string, action_kind string, alias string,
wildcard boolean, method string, queued boolean, callback_kind string, callback_class string, callback_method string, model string,
policy string, shared boolean, concrete_kind string, concrete_class string, concrete_file string, concrete_line int, expression string,
timezone string, command string, callback_target string, without_overlapping boolean, on_one_server boolean, kind string, channel_kind string
"""
EDGE_ATTRIBUTES = "file string, line int, character int, form string, source string, `order` int, via string, synthetic boolean, message string, expression string, method string"

#: The kinds of class-like nodes that listings cover.
LISTABLE_KINDS = [
    "controller", "model", "event", "listener", "job", "notification", "mailable", "policy", "form_request", "observer",
    "resource", "command", "service_provider", "cast", "middleware", "interface", "enum", "trait", "bootstrap", "class",
]


@dataclass(frozen=True)
class Graph:
    """nodes(project_slug, id, kind, name, a), edges(edge_seq, project_slug, source, target, kind, e), optional warnings."""

    nodes: DataFrame
    edges: DataFrame

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.nodes.where(F.col("kind").isin(*kinds))

    def edges_of(self, *kinds: str) -> DataFrame:
        return self.edges.where(F.col("kind").isin(*kinds))

    def cached(self) -> Graph:
        return replace(self, nodes=self.nodes.cache(), edges=self.edges.cache())


def unique_nodes(nodes: DataFrame, order: str | None = None) -> DataFrame:
    """First-wins by key: the row with the least ``order``, without one the least (kind, name, attributes)."""
    least = F.struct(*([order] if order else []), "kind", "name", "attributes")
    return nodes.groupBy(*KEY).agg(F.min(least).alias("r")).select(*KEY, "r.kind", "r.name", "r.attributes")


def unique_nodes_by_kind(nodes: DataFrame) -> DataFrame:
    """As ``unique_nodes`` where an id has one kind: with the kind among the keys, a filter on it reaches the scan."""
    return nodes.groupBy(*KEY, "kind").agg(F.min(F.struct("name", "attributes")).alias("r")).select(*KEY, "kind", "r.name", "r.attributes")


def parsed(nodes: DataFrame, edges: DataFrame) -> Graph:
    """A graph from raw tables with attributes as JSON text; unreadable attributes read as empty."""
    n = nodes.select(*KEY, "kind", "name", F.from_json("attributes", NODE_ATTRIBUTES).alias("a"))
    e = edges.select("edge_seq", "project_slug", "source", "target", "kind", F.from_json("attributes", EDGE_ATTRIBUTES).alias("e"))
    return Graph(n, e)


def load_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return parsed(unique_nodes_by_kind(table(spark, sf_dir, "nodes")), table(spark, sf_dir, "edges"))


def merge(one: DataFrame, other: DataFrame) -> DataFrame:
    """Union of two raw node tables; on equal keys the first one's node stays."""
    both = one.withColumn("_side", F.lit(0)).unionByName(other.withColumn("_side", F.lit(1)))
    return unique_nodes(both, "_side")


# --- one hop ----------------------------------------------------------------------------------------------------------


def outgoing(g: Graph, node_id: str | None = None, *kinds: str) -> DataFrame:
    """Edges by source; without an id, of every node."""
    edges = g.edges_of(*kinds) if kinds else g.edges
    return edges if node_id is None else edges.where(F.col("source") == node_id)


def incoming(g: Graph, node_id: str | None = None, *kinds: str) -> DataFrame:
    edges = g.edges_of(*kinds) if kinds else g.edges
    return edges if node_id is None else edges.where(F.col("target") == node_id)


def renamed_nodes(nodes: DataFrame, end: str, prefix: str) -> DataFrame:
    return nodes.select("project_slug", F.col("id").alias(end), F.col("kind").alias(f"{prefix}_kind"), F.col("name").alias(f"{prefix}_name"), F.col("a").alias(f"{prefix}_a"))


def with_targets(g: Graph, edges: DataFrame, how: str = "inner") -> DataFrame:
    """Edges with their target nodes as target_kind, target_name, target_a; dangling ones dropped (or kept, ``how='left'``)."""
    return edges.join(renamed_nodes(g.nodes, "target", "target"), ["project_slug", "target"], how)


def with_sources(g: Graph, edges: DataFrame, how: str = "inner") -> DataFrame:
    return edges.join(renamed_nodes(g.nodes, "source", "source"), ["project_slug", "source"], how)


def first_edge(edges: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """The edge that comes first in edge order per ``by``: a partial aggregation, no sort of a hub's edges."""
    return edges.groupBy(*by).agg(F.min(F.struct("edge_seq", *columns)).alias("r")).select(*by, *[f"r.{c.rsplit('.', 1)[-1]}" for c in columns])


def joined(values: Column, distinct: bool = True) -> Column:
    """Names as one text, sorted by code point."""
    return F.array_join(F.array_sort(F.collect_set(values) if distinct else F.collect_list(values)), ",")


def class_fqn(node_id: Column, name: Column | None = None) -> Column:
    """The class name in ``class:<fqn>``, even if the node is missing; else the node's name, else the id."""
    return F.when(node_id.startswith("class:"), F.substr(node_id, F.lit(7))).otherwise(F.coalesce(name, node_id) if name is not None else node_id)


def bare_event(node_id: Column) -> Column:
    """An event is known as ``event:X`` to its listeners and as ``class:X`` to its dispatchers; this is the X of both."""
    return F.regexp_replace(node_id, "^(event|class):", "")


def resolve_class(g: Graph, fqns: DataFrame) -> DataFrame:
    """(project_slug, fqn, node_id, exact) for requested (project_slug, fqn): by id, else the first node equal without regard to case."""
    ids = g.nodes.where(F.col("id").startswith("class:")).select("project_slug", F.col("id").alias("node_id"), F.lower("id").alias("low"))
    wanted = fqns.select("project_slug", "fqn", F.concat(F.lit("class:"), "fqn").alias("want")).withColumn("low", F.lower("want"))
    found = wanted.join(ids, ["project_slug", "low"]).withColumn("miss", (F.col("node_id") != F.col("want")).cast("int"))
    best = found.groupBy("project_slug", "fqn").agg(F.min(F.struct("miss", "node_id")).alias("r"))
    return best.select("project_slug", "fqn", "r.node_id", (F.col("r.miss") == 0).alias("exact"))


# --- many hops --------------------------------------------------------------------------------------------------------


def walk(g: Graph, roots: DataFrame, steps: DataFrame, max_depth: int, max_nodes: int, include_root: bool = False) -> DataFrame:
    """Breadth-first from many roots at once: (project_slug, root, id, depth, rank, via, edge_seq), rank in discovery order.

    ``roots``: (project_slug, root); ``steps``: (project_slug, source, target, edge_seq) in walking direction. A node counts
    once per root, at its first discovery (lowest rank of the discoverer, then edge order). Targets that are no nodes are
    neither reported nor followed. A root stops at ``max_nodes`` reported nodes. Each level is one join of the frontier with
    the edges, written to the checkpoint folder, so the plan does not grow with the depth.
    """
    per = ["project_slug", "root"]
    known = g.nodes.select("project_slug", "id")
    start = roots.select(*per).distinct().join(known.withColumnRenamed("id", "root"), per, "left_semi")
    frontier = start.select(*per, F.col("root").alias("id"), F.lit(0).alias("depth"), F.lit(0 if include_root else -1).cast("long").alias("rank"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("long").alias("edge_seq"))
    levels, visited = ([frontier] if include_root else []), frontier.select(*per, "id")
    taken = start.withColumn("taken", F.lit(1 if include_root else 0).cast("long"))
    reachable = steps.join(known.withColumnRenamed("id", "target"), ["project_slug", "target"], "left_semi")
    for depth in range(1, max_depth + 1):
        found = frontier.select(*per, F.col("id").alias("source"), F.col("rank").alias("parent_rank")).join(reachable, ["project_slug", "source"])
        first = found.groupBy(*per, F.col("target").alias("id")).agg(F.min(F.struct("parent_rank", "edge_seq", F.col("source").alias("via"))).alias("r"))
        first = first.join(visited, [*per, "id"], "left_anti").join(taken, per)
        order = Window.partitionBy(*per).orderBy("r.parent_rank", "r.edge_seq", "id")
        ranked = first.withColumn("rank", F.col("taken") + F.row_number().over(order) - 1).where(F.col("rank") < max_nodes)
        level = materialize(ranked.select(*per, "id", F.lit(depth).alias("depth"), "rank", "r.via", "r.edge_seq"))
        if not level.limit(1).count():
            break
        levels.append(level)
        visited = reduce(DataFrame.unionByName, [x.select(*per, "id") for x in levels], start.select(*per, F.col("root").alias("id"))).distinct()
        taken = start.join(reduce(DataFrame.unionByName, [x.select(*per) for x in levels]).groupBy(*per).agg(F.count("*").alias("taken")), per, "left").na.fill(0)
        frontier = level
    return reduce(DataFrame.unionByName, levels) if levels else frontier.limit(0)


def bfs(g: Graph, roots: DataFrame, kinds: list[str], max_depth: int = 5, node_limit: int = 200) -> DataFrame:
    """Level order with the root at depth 0, which counts towards the limit; forward edges of the given kinds."""
    steps = g.edges_of(*kinds).select("project_slug", "source", "target", "edge_seq")
    return walk(g, roots, steps, max_depth, node_limit, include_root=True)
