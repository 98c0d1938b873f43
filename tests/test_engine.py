import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import text as X
from graphloom.plans.engine import Engine
from graphloom.sources.documents import read_reflections
from helpers import make_graph, method


@pytest.fixture(scope="module")
def engine(spark):
    nodes = [
        ("route:GET:/a", "route", "/a", {"uri": "/a", "methods": ["GET"], "name": "a.index"}), method("App\\Models\\A", "go", line=3), method("App\\B", "run"), ("class:App\\Models\\A", "model", "A", {"fqn": "App\\Models\\A"}), ("class:App\\B", "class", "B", {"fqn": "App\\B"}),
        ("class:App\\E", "event", "E", {}), ("listener:L::handle", "listener", "L", {"class_fqn": "L", "method": "handle"}), ("class:App\\J", "job", "J", {}), ("cache_key:k.list", "cache_key", "k.list", {}), ("binding:Clock", "binding", "Clock", {"concrete_class": "Sys"}),
    ]
    m = "method:App\\Models\\A::go"
    edges = [("route:GET:/a", m, "routes_to"), (m, "class:App\\Models\\A", "part_of"), ("method:App\\B::run", m, "calls", {"line": 7}), (m, "class:App\\E", "fires"), ("listener:L::handle", "event:App\\E", "listens_to"), (m, "class:App\\J", "dispatches"), (m, "cache_key:k.list", "cache_read"), ("class:App\\B", "class:App\\Models\\A", "extends")]
    g = make_graph(spark, nodes, edges)
    embedder = X.HashingEmbedder(16)
    rows = [(str(i), "p", embedder.model_id, [float(v) for v in embedder.embed([t])[0]], (n,), None) for i, (t, n) in enumerate([("place the order", m), ("send a mail", "gone")])]
    vectors = spark.createDataFrame(rows, "id string, project_slug string, embedder_id string, vector array<float>, payload struct<node_id: string>, embedded_at timestamp")
    chunks = spark.createDataFrame([("c", "p", "method", "f.php", 0, 9, 3, 4, "x\ny", m, "A::go", None)], "id string, project_slug string, kind string, file_path string, start_byte int, end_byte int, start_line int, end_line int, text string, node_id string, symbol string, indexed_at timestamp")
    files = spark.createDataFrame([("f.php", "1\n2\n3\n", None)], "file_path string, text string, mtime timestamp")
    return Engine(spark, g, chunks, vectors, embedder, files)


def test_all_25_queries_are_there(engine):
    assert len(engine.names) == 25


@pytest.mark.parametrize(
    "name, args, total",
    [
        ("list_routes", {}, 1), ("list_by_kind", {"kind": "model"}, 1), ("describe_class", {"fqn": "app\\models\\a"}, 1), ("get_model_context", {"fqn": "App\\Models\\A"}, 1), ("trace_route", {"uri": "/a", "method": "get"}, 1), ("get_request_flow", {"route_id": "route:GET:/a"}, 1),
        ("find_handlers", {"handler_fqn": "App\\Models\\A::go"}, 1), ("find_listeners", {"event": "App\\E"}, 1), ("find_listeners", {"event": "E"}, 1), ("find_dispatchers", {"event": "event:App\\E"}, 1), ("find_event_chains", {"event": "App\\E"}, 1), ("find_jobs_dispatching", {"job": "J"}, 1), ("find_jobs_dispatching", {"job": "App\\J"}, 1),
        ("resolve_binding", {"abstract": "Clock"}, 1), ("find_implementations", {"interface_fqn": "App\\Models\\A"}, 1), ("find_implementations", {"interface_fqn": "App\\Models\\A", "include_subclasses": False}, 0), ("find_callers", {"method_fqn": "App\\Models\\A::go"}, 1), ("expand_call_tree", {"method_fqn": "App\\B::run"}, 1),
        ("find_cache_users", {"key": "list"}, 1), ("find_cache_users", {"key": "k.list", "mode": "write"}, 0), ("semantic_search", {"query": "place the order"}, 1), ("get_node_body", {"node_id": "method:App\\Models\\A::go"}, 1), ("get_full_block", {"file_path": "f.php", "start_line": 2, "end_line": 9}, 1), ("explore_entity", {"name": "a"}, 4),
        ("describe_flow", {"query": "/a"}, 1), ("list_scheduled_tasks", {}, 0), ("list_modules", {"min_classes": 1}, 4), ("describe_module", {"prefix": "App"}, 4),
    ],
)
def test_answers(engine, name, args, total):
    r = engine.query(name, **args)
    assert r.error_code is None and r.total == total


@pytest.mark.parametrize(
    "name, args, code",
    [
        ("nonsense", {}, "tool_not_found"), ("list_by_kind", {"kind": "route"}, "non_listable_kind"), ("list_routes", {"odd": 1}, "invalid_input"), ("describe_class", {"fqn": "No"}, "class_not_found"), ("trace_route", {"uri": "/b"}, "route_not_found"), ("find_handlers", {"method": "GET"}, "missing_filter"),
        ("find_listeners", {"event": "No"}, "event_not_found"), ("find_jobs_dispatching", {"job": "No"}, "job_not_found"), ("get_policy_for", {"model_fqn": "No"}, "model_not_found"), ("get_policy_for", {"model_fqn": "App\\Models\\A"}, "policy_not_found"), ("resolve_binding", {"abstract": "No"}, "binding_not_found"),
        ("find_callers", {"method_fqn": "No::x"}, "method_not_found"), ("expand_call_tree", {"method_fqn": "App\\B::run", "direction": "up"}, "invalid_direction"), ("find_cache_users", {"key": "zzz"}, "key_not_found"), ("find_cache_users", {"key": "k", "mode": "both"}, "invalid_mode"), ("explore_entity", {"name": "zzz"}, "no_matches"),
        ("describe_module", {"prefix": "Zzz"}, "empty_module"), ("get_node_body", {"node_id": "no"}, "node_not_found"), ("get_full_block", {"file_path": "no", "start_line": 1, "end_line": 1}, "file_not_found"), ("semantic_search", {"query": "zzz qqq", "min_vector_score": 0.99}, "low_relevance"),
    ],
)
def test_error_codes(engine, name, args, code):
    assert engine.query(name, **args).error_code == code


def test_calls_not_indexed_and_projects(spark, engine):
    other = Engine(spark, engine.graph, calls_indexed=False)
    assert other.query("expand_call_tree", method_fqn="App\\B::run").error_code == "calls_not_indexed"
    assert other.query("find_callers", method_fqn="App\\B::run").error_code == "calls_not_indexed"
    assert other.query("find_callers", method_fqn="App\\Models\\A::go").total == 1
    assert engine.for_project("q").query("list_routes").total == 0


def test_questions_are_answered_traced_or_refused(engine):
    a = engine.ask("who listens to App\\E?")
    assert (a.tool, a.result.count()) == ("find_listeners", 1)
    assert engine.ask("place the order").tool == "semantic_search"
    assert engine.ask("entirely different words").error_code == "no_confident_match"
    assert engine.ask("list all routes").tool == "list_routes"
    assert engine.traces[-1]["kind"] == "ask_envelope" and engine.traces[-2]["kind"] == "ask_refusal"


def test_reflection_files(spark, tmp_path):
    for name, body in {"a": json.dumps({"schema_version": "2.1.0", "project": {"name": "p"}}), "b": "{", "c": '{"schema_version": "3.0.0"}', "d": "[1]"}.items():
        (tmp_path / f"{name}.json").write_text("﻿" + body)
    got = sorted((r["project_slug"] or "", r["error_code"] or "") for r in read_reflections(spark, f"file://{tmp_path}").collect())
    assert got == [("", "parse_error"), ("", "parse_error"), ("", "unsupported_version"), ("p", "")]
    with pytest.raises(Exception):
        read_reflections(spark, f"file://{tmp_path}/none").count()
