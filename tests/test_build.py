import json

from graphloom.operators import build as B
from graphloom.operators import graph as G
from graphloom.operators import nested as N
from graphloom.plans import tools as T

SCHEMA = "document_id bigint, project_slug string, received_at timestamp, body string, kind string"


def cls(name, kinds=(), parent=None, methods=(), **more):
    ms = [m if isinstance(m, dict) else {"name": m} for m in methods]
    return {"source": "project", "kinds": list(kinds), "reflection": {"name": name, "short_name": name.rsplit("\\", 1)[-1], "file": f"/{name}.php", "parent": parent, "interfaces": [], "traits": [], "methods": ms} | more}


DOCUMENT = {
    "schema_version": "2.6.0",
    "sections": {
        "classes": {
            "items": [
                cls("A\\Ctl", ["controller", "job"], "A\\Base", [{"name": "store", "line": 10, "parameters": [{"name": "r", "type": "A\\Req"}, {"name": "n", "type": "int"}]}, {"name": "show", "line": 30}], interfaces=["A\\I"], traits=["A\\T"]),
                cls("A\\Req", ["form_request"]), cls("A\\Ask", []), cls("A\\AskHandler", [], methods=["__invoke"]), cls("A\\PayCommand"), cls("B\\PayHandler", methods=["handle"]), cls("C\\PayHandler", methods=["handle"]),
                cls("A\\Child", [], "A\\Mid"), cls("A\\Mid", [], "V\\Thing"), cls("A\\Ctl", ["model"]),
            ]
        },
        "routes": {"items": [{"uri": "/a", "methods": ["POST", "PUT"], "name": None, "middleware": ["auth", "throttle:1"], "wheres": [], "action": {"kind": "controller", "controller": "A\\Ctl", "method": "store"}}, {"uri": "/b", "methods": [], "action": {"kind": "controller", "controller": "A\\Ctl"}}]},
        "events": {"listeners": {"A\\E": [{"kind": "closure"}, "A\\L@go", {"kind": "class", "class": "A\\M"}]}, "wildcards": [{"event": "a.*", "listeners": [{"kind": "class", "class": "A\\M", "queued": True}]}]},
        "gates_policies": {"gates": [{"ability": "edit", "callback": {"kind": "closure"}}], "policies": [{"model": "A\\Model", "policy": "A\\Pol"}]},
        "middleware": {"aliases": {"auth": "A\\Auth"}},
        "bindings": {"bindings": [{"abstract": "A\\I", "shared": True, "concrete": {"kind": "closure"}}, {"abstract": "A\\J", "concrete": "A\\K"}]},
        "schedule": [{"expression": "* * * * *", "kind": "callback", "target": "A\\Job", "description": None}, {"expression": "0 0 * * *", "command": "cache:clear", "description": "Clear"}],
        "static_analysis": {
            "findings": [
                {"kind": "event_dispatch", "target": "A\\E", "in_class": "A\\Ctl", "in_method": "store", "file": "f", "line": 12, "meta": []},
                {"kind": "cache_write", "target": "k", "in_class": "A\\Ctl", "in_method": None, "line": 3, "meta": {"form": "literal"}},
                {"kind": "view_return", "target": "v.x", "in_class": "A\\Ctl", "in_method": "show"}, {"kind": "gate_check", "target": "edit", "in_class": "A\\Ctl", "in_method": "show"},
                {"kind": "observer_registration", "target": "A\\Obs", "meta": {"model": "A\\Model"}}, {"kind": "broadcast_channel", "target": "orders", "in_class": "A\\E", "meta": {"channel_kind": "PrivateChannel"}},
                {"kind": "closure_binding", "target": "A\\Impl", "meta": {"abstract": "A\\I", "binding_kind": "bind"}}, {"kind": "closure_binding", "target": "A\\New", "meta": {"abstract": "A\\N", "binding_kind": "singleton"}},
                {"kind": "bus_dispatch", "target": "A\\Ask", "in_class": "A\\Ctl", "in_method": "show", "line": 31}, {"kind": "bus_dispatch", "target": "A\\PayCommand", "in_class": "A\\Ctl", "in_method": "show"}, {"kind": "form_request_rules", "target": "x", "in_class": "A\\Ctl"},
                {"kind": "job_dispatch", "target": None, "in_class": "A\\Ctl"},
            ]
        },
    },
}


def built(spark, **more):
    docs = spark.createDataFrame([(1, "p", None, json.dumps(DOCUMENT), "clash"), (2, None, None, json.dumps(DOCUMENT), ""), (3, "q", None, "{bad", ""), (4, "r", None, json.dumps(DOCUMENT | {"schema_version": "1.0"}), "")], SCHEMA)
    return B.build_graph(docs, **more)


def test_nodes_edges_and_warnings(spark):
    b = built(spark)
    nodes = {r["id"]: r for r in b.nodes.collect()}
    assert {r["project_slug"] for r in nodes.values()} == {"p"}
    assert {i: nodes[i]["kind"] for i in ("class:A\\Ctl", "class:A\\Req", "class:A\\Ask", "route:POST:/a", "route:ANY:/b", "event:a.*", "listener:A\\L::go", "gate:edit", "policy:A\\Pol", "middleware:auth", "binding:A\\N", "schedule:* * * * *|A\\Job", "cache_key:k", "view:v.x", "broadcast_channel:PrivateChannel:orders")} == {
        "class:A\\Ctl": "controller", "class:A\\Req": "form_request", "class:A\\Ask": "class", "route:POST:/a": "route", "route:ANY:/b": "route", "event:a.*": "event", "listener:A\\L::go": "listener", "gate:edit": "gate", "policy:A\\Pol": "policy",
        "middleware:auth": "middleware", "binding:A\\N": "binding", "schedule:* * * * *|A\\Job": "scheduled_task", "cache_key:k": "cache_key", "view:v.x": "view", "broadcast_channel:PrivateChannel:orders": "broadcast_channel",
    }
    assert json.loads(nodes["event:a.*"]["attributes"]) == {"wildcard": True} and json.loads(nodes["method:A\\Ctl::store"]["attributes"])["line"] == 10
    edges = {(r["source"], r["target"], r["kind"]) for r in b.edges.collect()}
    assert {
        ("class:A\\Ctl", "class:A\\Base", "extends"), ("class:A\\Ctl", "class:A\\I", "implements"), ("class:A\\Ctl", "class:A\\T", "uses_trait"), ("method:A\\Ctl::store", "class:A\\Ctl", "part_of"), ("method:A\\Ctl::store", "class:A\\Req", "validates_with"),
        ("route:POST:/a", "method:A\\Ctl::store", "routes_to"), ("route:POST:/a", "middleware:throttle:1", "has_middleware"), ("listener:A\\M::handle", "event:A\\E", "listens_to"), ("policy:A\\Pol", "class:A\\Model", "applies_to"),
        ("binding:A\\I", "class:A\\Impl", "bound_to"), ("binding:A\\J", "class:A\\K", "bound_to"), ("schedule:* * * * *|A\\Job", "class:A\\Job", "runs_command"), ("method:A\\Ctl::store", "class:A\\E", "fires"), ("class:A\\Ctl", "cache_key:k", "cache_write"),
        ("method:A\\Ctl::show", "view:v.x", "returns_view"), ("method:A\\Ctl::show", "gate:edit", "authorised_by"), ("class:A\\Obs", "class:A\\Model", "observes"), ("class:A\\E", "broadcast_channel:PrivateChannel:orders", "broadcasts_to"),
        ("method:A\\Ctl::show", "method:A\\AskHandler::__invoke", "calls"),
    } <= edges
    assert not any(k == "validates_with" and t == "class:int" for _, t, k in edges) and not any(k == "dispatches" for *_, k in edges)
    assert sorted(r["code"] for r in b.warnings.collect()) == ["bus_handler_ambiguous", "closure_listener", "route_action_incomplete"]
    orders = {r["target"]: json.loads(r["attributes"])["order"] for r in b.edges.where("kind = 'listens_to' AND source = 'listener:A\\\\M::handle'").collect()}
    assert orders == {"event:A\\E": 2, "event:a.*": 0}
    seqs = [r["edge_seq"] for r in b.edges.orderBy("edge_seq").collect()]
    assert seqs == list(range(1, len(seqs) + 1))


def test_custom_bases_reach_through_the_parent_chain(spark):
    nodes = {r["id"]: r["kind"] for r in built(spark, custom_bases={"V\\Thing": "event", "A\\Base": "odd"}).nodes.collect()}
    assert nodes["class:A\\Child"] == nodes["class:A\\Mid"] == "event" and nodes["class:A\\Ctl"] == "controller"


def test_queries_on_the_built_graph(spark):
    b = built(spark)
    g = G.parsed(b.nodes, b.edges)
    bound = {r["abstract"]: r for r in T.resolve_binding(g).collect()}
    assert {a: r["concrete_class"] for a, r in bound.items()} == {"A\\I": "A\\Impl", "A\\J": "A\\K", "A\\N": "A\\New"} and bound["A\\N"]["shared"] and bound["A\\I"]["concrete_kind"] == "class"
    tasks = {r["expression"]: r for r in T.list_scheduled_tasks(g).collect()}
    assert tasks["* * * * *"]["target"] == "A\\Job" and tasks["0 0 * * *"]["command"] == "cache:clear" and tasks["0 0 * * *"]["description"] == "Clear"
    assert [r["id"] for r in T.list_scheduled_tasks(g, target_glob="cache:*").collect()] == ["schedule:0 0 * * *|cache:clear"]


def test_enclosing_calls_is_an_as_of_join(spark):
    methods = spark.createDataFrame([("p", "m1", "f", 10), ("p", "m2", "f", 20), ("q", "m3", "f", 1), ("p", "m4", None, 1)], "project_slug string, method_id string, file string, start_line int")
    refs = [("p", "t", "f", 9, 0), ("p", "t", "f", 10, 1), ("p", "t", "f", 19, 2), ("p", "t", "f", 99, 3), ("p", "m2", "f", 25, 4), ("p", "t", "g", 5, 5), ("p", "t", "f", 10, 1)]
    got = B.enclosing_calls(spark.createDataFrame(refs, "project_slug string, target string, file string, line int, character int"), methods).collect()
    assert sorted((r["source"], r["line"]) for r in got) == [("m1", 10), ("m1", 19), ("m2", 99)]


def test_carry_forward(spark):
    nodes = spark.createDataFrame([("p", f"class:C{i}", "class", "", f'{{"file": "f{i}"}}') for i in range(4)] + [("p", f"method:C{i}::m", "method", "m", f'{{"class_fqn": "C{i}", "line": 1}}') for i in range(4)], "project_slug string, id string, kind string, name string, attributes string")
    calls = "project_slug string, source string, target string, file string, line int, character int"
    old = spark.createDataFrame([("p", "method:C0::m", "method:C1::m", "f0", 1, 0), ("p", "method:C0::m", "method:C2::m", "f0", 2, 0), ("p", "gone", "method:C1::m", "x", 3, 0)], calls)
    new = spark.createDataFrame([("p", "method:C3::m", "method:C2::m", "f3", 4, 0)], calls)
    changed = lambda *f: spark.createDataFrame([("p", x) for x in f], "project_slug string, file string")
    lines = lambda df: sorted(r["line"] for r in df.collect())
    assert lines(B.carry_forward(old, new, nodes, changed("f2"))) == [1, 4]
    assert lines(B.carry_forward(old, new, nodes, changed("f0", "f2", "f3"))) == [4]


def test_empty_table(spark):
    b = B.build_graph(spark.createDataFrame([], SCHEMA))
    assert b.nodes.count() == b.edges.count() == b.warnings.count() == 0


def test_deep_bodies_are_built(spark):
    deep = '{"x": ' * 5000 + "1" + "}" * 5000
    body = '{"schema_version": "2.6.0", "other": %s, "sections": {"classes": {"items": [{"kinds": [], "reflection": {"name": "A\\\\B", "attributes": %s}}]}}}' % (deep, deep)
    docs = spark.createDataFrame([(1, "p", None, body, "")], SCHEMA)
    assert [r["id"] for r in B.build_graph(docs).nodes.collect()] == ["class:A\\B"]
    items = list(B.regular_items(N.read_json(body)))
    assert B.shallower({"a": [{"b": 1}]}, 2) == {"a": [None]} and len(items) == 1
