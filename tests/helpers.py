import json

from graphloom.operators import graph as G

NODES = "project_slug string, id string, kind string, name string, attributes string"
EDGES = "edge_seq bigint, project_slug string, source string, target string, kind string, attributes string"


def make_graph(spark, nodes, edges, slug="p"):
    """nodes: (id, kind, name, attributes), edges: (source, target, kind[, attributes]) in order."""
    n = [(slug, i, k, name, json.dumps(a) if isinstance(a, dict) else a) for i, k, name, a in nodes]
    e = [(s + 1, slug, *x[:3], json.dumps(x[3]) if len(x) > 3 else "{}") for s, x in enumerate(edges)]
    raw = spark.createDataFrame(n, NODES)
    return G.parsed(G.unique_nodes(raw), spark.createDataFrame(e, EDGES))


def method(c, m, **a):
    return (f"method:{c}::{m}", "method", m, {"class_fqn": c} | a)
