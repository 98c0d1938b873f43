import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom.functions.glob import glob_regex
from graphloom.operators import graph as G
from graphloom.plans import graph_queries as Q
from graphloom.plans import tools as T
from helpers import make_graph, method


def reference_walk(nodes, edges, root, max_depth, max_nodes, include_root):
    """First-in-first-out walk; dangling targets are visited but neither reported nor followed."""
    out, seen, queue = ([(root, 0)] if include_root else []), {root}, deque([(root, 0)])
    while queue:
        at, depth = queue.popleft()
        if depth == max_depth:
            continue
        for s, t in edges:
            if s != at or t in seen:
                continue
            seen.add(t)
            if t not in nodes:
                continue
            if len(out) >= max_nodes:
                return out
            out.append((t, depth + 1))
            queue.append((t, depth + 1))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_walk_matches_a_queue(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    nodes = names[:7]
    edges = [(rng.choice(nodes), rng.choice(names)) for _ in range(rng.randint(5, 25))]
    g = make_graph(spark, [(n, "method", n, {}) for n in nodes], [(s, t, "calls") for s, t in edges])
    depth, cap, include = rng.randint(1, 4), rng.choice([2, 4, 100]), bool(seed % 2)
    roots = g.nodes.select("project_slug", F.col("id").alias("root")).unionByName(g.nodes.limit(1).select("project_slug", F.lit("absent").alias("root")))
    got = {}
    for r in G.walk(g, roots, g.edges.select("project_slug", "source", "target", "edge_seq"), depth, cap, include).collect():
        got.setdefault(r["root"], []).append((r["rank"], r["id"], r["depth"]))
    for root in nodes:
        want = reference_walk(set(nodes), edges, root, depth, cap, include)
        assert [(i, d) for _, i, d in sorted(got.get(root, []))] == want
        assert [r for r, _, _ in sorted(got.get(root, []))] == list(range(len(want)))
    assert "absent" not in got


def test_call_tree_carries_call_sites(spark):
    g = make_graph(spark, [method("X", m) for m in "abcdef"], [(f"method:X::{s}", f"method:X::{t}", "calls", {"line": i}) for i, (s, t) in enumerate(["ab", "bc", "cd", "ae", "bf"], 1)])
    roots = g.nodes.where("name = 'a'").select("project_slug", F.col("id").alias("root"))
    rows = T.expand_call_tree(g, roots, max_depth=2).orderBy("rank").collect()
    assert [(r["method"], r["depth"], r["call_site_line"]) for r in rows] == [("b", 1, 1), ("e", 1, 4), ("c", 2, 2), ("f", 2, 5)]
    up = T.expand_call_tree(g, g.nodes.where("name = 'd'").select("project_slug", F.col("id").alias("root")), "upstream", 5).orderBy("rank").collect()
    assert [r["method"] for r in up] == ["c", "b", "a"]
    with pytest.raises(ValueError):
        T.expand_call_tree(g, roots, "sideways")


def test_nodes_are_first_wins_and_attributes_forgiving(spark):
    g = make_graph(spark, [("a", "route", "a", "[]"), ("a", "route", "a", None), ("b", "route", "b", "not json"), ("c", "route", "c", {"uri": "/x", "methods": ["GET", "HEAD"], "name": None})], [])
    rows = {r["route_id"]: r for r in T.list_routes(g).collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"]["uri"] == "a" and rows["b"]["action_kind"] == "unknown" and rows["c"]["methods"] == "GET,HEAD"


def test_missing_targets_are_dropped_or_kept_as_each_query_says(spark):
    g = make_graph(spark, [("r", "route", "r", {"uri": "/a"}), method("C", "m")], [("r", "method:C::m", "routes_to"), ("r", "middleware:auth:api", "has_middleware"), ("r", "method:Gone::x", "routes_to")])
    assert T.list_routes(g).first()["middleware"] == ""
    traced = T.trace_route(g).first()
    assert traced["middleware"] == "auth:api" and traced["handler"] == "C"


def test_filters_of_list_routes(spark):
    g = make_graph(spark, [(f"r{i}", "route", f"r{i}", {"uri": u, "methods": v, "name": n}) for i, (u, v, n) in enumerate([("/api/users", ["GET"], "users.index"), ("/api/users/{id}", ["POST"], None), ("/home", ["GET"], "home")])], [])
    ids = lambda **k: sorted(r["route_id"] for r in T.list_routes(g, **k).collect())
    assert ids(method="get") == ["r0", "r2"] and ids(uri_glob="/api/*") == ["r0", "r1"] and ids(uri_glob="api/users") == ["r0"] and ids(name_glob="*") == ["r0", "r2"] and ids(method="GET", uri_glob="*me") == ["r2"]


def test_event_chain_with_a_cycle_uses_both_event_ids(spark):
    nodes = [("class:E", "event", "E", {}), ("event:E", "event", "E", {}), ("event:F", "event", "F", {}), ("listener:L::handle", "listener", "L", {"class_fqn": "L", "method": "handle"}), ("listener:M::go", "listener", "M", {"class_fqn": "M", "method": "go"}), method("L", "handle")]
    edges = [("listener:L::handle", "event:E", "listens_to", {"order": 2}), ("listener:M::go", "event:E", "listens_to", {"order": 1}), ("method:L::handle", "class:F", "fires"), ("listener:M::go", "event:F", "listens_to"), ("listener:M::go", "class:E", "fires")]
    g = make_graph(spark, nodes, edges)
    assert [r["listener_fqn"] for r in T.listeners(g).where("event = 'E'").orderBy("position").collect()] == ["M", "L"]
    steps = {(r["depth"], r["parent_event"], r["listener"], r["child_event"]) for r in T.find_event_chains(g, 4).where("root = 'E'").collect()}
    assert steps == {(1, "E", "L", "F"), (1, "E", "M", "E"), (2, "F", "M", "E")}


def test_classes_models_and_policies(spark):
    c = lambda n, k, **a: (f"class:{n}", k, n.rsplit("\\", 1)[-1], {"fqn": n} | a)
    nodes = [
        c("A\\Order", "model", readonly=True, cases=[{"name": "x"}, {"value": 1}]), c("A\\OrderPolicy", "policy", file="p.php"), c("A\\OrderObserver", "observer"), c("A\\Base", "class"), c("A\\Can", "interface"),
        method("A\\Order", "scopeOpen"), method("A\\Order", "getNameAttribute"), method("A\\Order", "setNameAttribute"), method("A\\Order", "lines", return_type="Rel\\HasMany"), method("A\\Order", "go"), method("A\\OrderPolicy", "view"),
        ("cache_key:k", "cache_key", "k", {}), ("view:v", "view", "v", {}),
    ]
    m = lambda n: (f"method:A\\Order::{n}", "class:A\\Order", "part_of")
    edges = [m(n) for n in ("scopeOpen", "getNameAttribute", "setNameAttribute", "lines", "go")] + [
        ("method:A\\OrderPolicy::view", "class:A\\OrderPolicy", "part_of"), ("class:A\\OrderPolicy", "class:A\\Order", "applies_to"), ("class:A\\Order", "class:A\\Base", "extends"), ("class:A\\Order", "class:A\\Can", "implements"), ("class:A\\Order", "class:Gone", "implements"),
        ("method:A\\Order::go", "cache_key:k", "cache_write", {"form": "literal"}), ("method:A\\Order::lines", "cache_key:k", "cache_read", {"form": "prefix", "line": 0}), ("method:A\\Order::go", "view:v", "returns_view"), ("method:A\\Order::go", "method:A\\Order::lines", "calls", {"line": 0}),
    ]
    g = make_graph(spark, nodes, edges)
    d = T.describe_class(g).where("class_id = 'class:A\\\\Order'").first()
    assert (d["parent"], d["interfaces"], d["views"], d["readonly"], d["case_count"]) == ("A\\Base", "A\\Can,Gone", "v", True, 1)
    assert d["methods"] == "getNameAttribute,go,lines,scopeOpen,setNameAttribute"
    k = T.class_cache_keys(g).first()
    assert (k["key"], k["mode"], k["form"]) == ("k", "both", "literal")
    rows = T.get_model_context(g).collect()
    assert {r["method"]: r["category"] for r in rows} == {"scopeOpen": "scope", "getNameAttribute": "accessor", "setNameAttribute": "mutator", "lines": "relation", "go": "method"}
    assert rows[0]["policy"] == "A\\OrderPolicy" and rows[0]["observers"] == "A\\OrderObserver"
    p = T.get_policy_for(g).first()
    assert (p["policy_fqn"], p["file"], p["methods"]) == ("A\\OrderPolicy", "p.php", "view")
    assert {(r["interface"], r["via"]) for r in T.find_implementations(g).collect()} == {("A\\Can", "implements"), ("Gone", "implements"), ("A\\Base", "extends")}
    assert {r["key"] for r in T.cache_keys_matching(g, "k").collect()} == {"k"} == {r["key"] for r in T.cache_keys_matching(g, "[j-l]").collect()}
    assert {r["match_quality"] for r in T.explore_entity(g, "order").collect()} == {"exact_name", "prefix"}
    asked = spark.createDataFrame([("p", "a\\order"), ("p", "A\\Order"), ("p", "Nope")], "project_slug string, fqn string")
    assert {(r["fqn"], r["exact"]) for r in G.resolve_class(g, asked).collect()} == {("a\\order", False), ("A\\Order", True)}


def test_modules(spark):
    names = ["App\\Modules\\Sales\\Order", "App\\Modules\\Sales\\Sub\\Line", "App\\Modules\\Top", "App\\Http\\X", "Single"]
    g = make_graph(spark, [(f"class:{n}", "class", n.rsplit("\\", 1)[-1], {}) for n in names], [])
    assert {(r["prefix"], r["class_count"]) for r in T.list_modules(g, 1).collect()} == {("App\\Modules\\Sales", 2), ("App\\Modules", 1), ("App\\Http", 1)}
    m = T.describe_module(g, "App\\Modules\\").first()
    assert (m["total"], m["submodules"]) == (3, "Sales")


@pytest.mark.parametrize("glob, text, hit", [("*", "a/b\nc", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("[", "[", True), ("a.b", "axb", False), ("[]]x", "]x", True), ("a+(b)", "a+(b)", True), ("[a-c]\\", "b\\", True)])
def test_globs(glob, text, hit):
    import fnmatch
    import re

    assert bool(re.match(glob_regex(glob).replace("\\Z", "$"), text)) == hit == fnmatch.fnmatchcase(text, glob)


def test_empty_graph(spark):
    g = make_graph(spark, [], [])
    for f in (T.list_routes, T.list_modules, T.describe_class, T.get_model_context, T.trace_route, T.listeners, T.find_event_chains, T.get_request_flow, T.get_policy_for, T.resolve_binding, T.list_scheduled_tasks):
        assert f(g).count() == 0


def test_call_trees_of_all_start_at_callers_no_route_leads_to(spark):
    g = make_graph(spark, [("route:r", "route", "r", {}), method("Routed", "a"), method("Job", "b"), method("Deep", "c")], [("route:r", "method:Routed::a", "routes_to"), ("method:Routed::a", "method:Deep::c", "calls"), ("method:Job::b", "method:Deep::c", "calls", {"line": 7})])
    rows = {(r["root"], r["id"], r["depth"], r["call_site_line"]) for r in Q._call_trees(g, "downstream").collect()}
    assert rows == {("method:Routed::a", "method:Deep::c", 1, None), ("method:Job::b", "method:Deep::c", 1, 7)}
    assert "expand_call_tree" in Q.QUERIES and "expand_call_tree" in Q.ORACLE


def test_full_bfs_goes_five_levels_deep_and_on_to_two_hundred_nodes(spark):
    chain, hub = [f"c{i}" for i in range(7)], [f"h{i:03}" for i in range(210)]
    nodes = [("route:deep", "route", "deep", {}), ("route:wide", "route", "wide", {})] + [(i, "method", i, {}) for i in chain + hub]
    edges = [("route:deep", "c0", "routes_to"), *[(a, b, "calls") for a, b in zip(chain, chain[1:])], *[("route:wide", i, "routes_to") for i in hub]]
    rows = Q._bfs(make_graph(spark, nodes, edges)).collect()
    assert sorted((r["depth"], r["id"]) for r in rows if r["root"] == "route:deep") == [(0, "route:deep"), *enumerate(chain[:5], 1)]
    assert sorted(r["id"] for r in rows if r["root"] == "route:wide") == [*hub[:199], "route:wide"]
    assert {"bfs"} <= set(Q.QUERIES) & set(Q.ORACLE)


def test_what_bounds_a_call_tree(spark):
    chain = [f"c{i}" for i in range(6)]
    nodes = [(i, "method", i, {}) for i in [*chain, "wide", "x", "y", "z", "loop"]]
    edges = [(a, b, "calls") for a, b in zip(chain, chain[1:])] + [("wide", i, "calls") for i in ("x", "y", "z")] + [("loop", "loop", "calls"), ("x", "gone", "calls")]
    g = make_graph(spark, nodes, edges)
    roots = spark.createDataFrame([("p", i) for i in ("c0", "c2", "wide", "loop", "x", "absent")], "project_slug string, root string")
    assert {(r["root"], r["nodes"], r["truncated_reason"]) for r in T.call_tree_limits(g, roots).collect()} == {("c0", 3, "max_depth"), ("c2", 3, None), ("wide", 3, None), ("loop", 0, None), ("x", 0, None)}
    assert {(r["root"], r["truncated_reason"]) for r in T.call_tree_limits(g, roots, max_nodes=3).collect() if r["nodes"]} == {("c0", "max_nodes"), ("c2", "max_nodes"), ("wide", "max_nodes")}
