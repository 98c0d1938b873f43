import json

import pytest

from graphloom.operators import profiles as P
from graphloom.plans import responses as R
from graphloom.sources import stores as S
from graphloom.streaming import sync
from helpers import EDGES, NODES


def test_graph_store_replaces_atomically(spark, tmp_path):
    store = S.GraphStore(spark, f"file://{tmp_path}/g")
    assert store.load() is None and store.node_count() == 0
    nodes = spark.createDataFrame([("p", "a", "controller_method", "a", "{}"), ("p", "b", "class", "b", "{}")], NODES)
    edges = spark.createDataFrame([(1, "p", "a", "gone", "calls", "{}"), (2, "p", "lost", "a", "calls", "{}")], EDGES)
    store.persist(nodes, edges, spark.createDataFrame([], "project_slug string, code string, context string"))
    g = store.load()
    assert {r["kind"] for r in g.nodes.collect()} == {"method", "class"} and store.edge_count() == 1
    assert [tuple(r) for r in store.read("warnings").collect()] == [("p", "dangling_edges_dropped", "1")]
    store.persist(nodes.limit(1), edges.limit(0), store.read("warnings").limit(0))
    assert store.node_count() == 1 and store.edge_count() == 0
    store.clear()
    assert store.load() is None


def test_vector_store(spark, tmp_path):
    t = "id string, vector array<float>, payload string"
    store = S.VectorStore(spark, f"file://{tmp_path}/v", 2)
    one = lambda *rows: spark.createDataFrame([(i, v, "") for i, v in rows], t)
    assert store.search(one(), 3) is None and store.count() == 0
    store.upsert(one(("a", [1.0, 0.0]), ("b", [0.0, 1.0])))
    for bad in ([1.0], None):
        with pytest.raises(ValueError, match="1 vectors"):
            store.upsert(one(("c", [1.0, 0.0]), ("bad", bad)))
    assert store.count() == 2
    store.upsert(one(("b", [1.0, 1.0]), ("c", [-1.0, 0.0])))
    hits = store.search(spark.createDataFrame([("q", [1.0, 0.0])], "id string, vec array<float>"), 2).orderBy("rank").collect()
    assert [(h["id"], h["score"]) for h in hits] == [("a", 1.0), ("b", 0.707107)]
    store.delete(spark.createDataFrame([("a",)], "id string"))
    store.purge(spark.createDataFrame([("c",)], "id string"))
    assert store.count() == 1


def test_streaming_sync_is_idempotent(spark, tmp_path):
    store = S.VectorStore(spark, f"file://{tmp_path}/v", 2)
    schema = "id string, vector array<float>, payload string"
    for i in range(2):
        spark.createDataFrame([(str(i), [1.0, float(i)], "")], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        sync.sync_vectors(stream, store, lambda df: df, f"{tmp_path}/ck").awaitTermination()
        assert store.count() == i + 1


def test_streaming_changes(spark, tmp_path):
    from graphloom.operators.incremental import CommitLog, committed_output

    schema = "change_id bigint, project_slug string, commit_sha string, commit_no int, file_path string, content_sha string, received_at timestamp"
    log = CommitLog(spark, f"file://{tmp_path}/log")
    import datetime as dt

    for i in range(2):
        spark.createDataFrame([(i, "p", "a" * 40, i, "f", "c", dt.datetime(2025, 1, 1 + i))], schema).write.mode("append").parquet(f"{tmp_path}/in")
        sync.sync_changes(spark, f"{tmp_path}/in", schema, log, f"{tmp_path}/ck").awaitTermination()
    assert sorted(r["change_id"] for r in committed_output(spark, log).collect()) == [0, 1]


def test_small_files(tmp_path):
    S.write_meta(f"{tmp_path}/m/meta.json", {"slug": "p"})
    assert S.read_meta(f"{tmp_path}/m/meta.json")["slug"] == "p" and S.read_meta(f"{tmp_path}/none") is None
    (tmp_path / "c.yml").write_text("schema_version: '1.2'\na: 1\n")
    assert S.load_config(f"{tmp_path}/c.yml")["a"] == 1 and S.load_config(f"{tmp_path}/none.yml") == {}
    (tmp_path / "c.yml").write_text("schema_version: 2\n")
    with pytest.raises(ValueError):
        S.load_config(f"{tmp_path}/c.yml")
    (tmp_path / "composer.json").write_text(json.dumps({"name": "a/b", "autoload": {"psr-4": {"A\\": "src"}}, "require": {"x/y": "*"}}))
    meta = S.package_metadata(f"{tmp_path}/composer.json", tag="v1.2")
    assert (meta["version"], meta["requires"]) == ("1.2", ["x/y"]) and S.package_metadata(f"{tmp_path}/composer.json", branch="main")["version"] == "dev-main"
    assert S.changed_files(str(tmp_path), None) is None


def test_traces(spark, tmp_path):
    good = {"ts": "t", "trace_id": "a", "schema_version": 1, "kind": "tool_executed", "query": "q", "duration_ms": 5}
    docs = spark.createDataFrame([("\n".join([json.dumps(good), json.dumps(good | {"kind": "ask_refusal"}), '{"cut": ', "no json"]),), (None,)], "text string")
    records = S.trace_records(docs)
    S.append_traces(records, f"{tmp_path}/t")
    (tmp_path / "t" / "bad.json").write_text('{"trace_id": \n')
    s = S.trace_summary(S.read_traces(spark, f"{tmp_path}/t")).where("trace_id = 'a'").first()
    assert (s["queries"], s["tool_calls"], s["duration_ms"], s["outcome"]) == ("q", 1, 10.0, "refused")


def test_profiles(spark):
    files = [("p", f"app/Actions/A{i}Action.php") for i in range(5)] + [("p", "app/Modules/X/Domain/D.php"), ("q", "app/Modules/X/Y/Domain/D.php"), ("q", "app/ActionsOther/B.php")]
    rows = P.profile_scores(spark.createDataFrame(files, "project_slug string, path string"), spark.createDataFrame([("p", "laravel/framework"), ("r", "filament/filament")], "project_slug string, package string")).collect()
    score = {(r["project_slug"], r["profile"]): r["score"] for r in rows}
    assert score["p", "laravel-actions"] == 70 and score["p", "laravel-default"] == 30 and score["p", "laravel-ddd"] == 50 and score["q", "laravel-ddd"] == 0 and score["q", "laravel-actions"] == 0 and score["r", "laravel-filament"] == 50
    assert [r["profile"] for r in rows if r["project_slug"] == "p" and r["position"] == 1] == ["laravel-actions"]


def test_responses(spark):
    df = spark.range(7).selectExpr("id", "sequence(0, id) AS xs")
    r = R.trim(df, ["id"], 3)
    assert (r.total, r.returned, r.truncated, r.truncated_lists, r.rows.count()) == (7, 3, True, ["rows:7→3"], 3) and not R.trim(df, ["id"], 0).truncated
    rows = R.trim_arrays(df, 5).where("id = 6").first()
    assert len(rows["xs"]) == 5 and rows["truncated_lists"] == ["xs:7→5"]
    assert R.attribution("a/b", "1", list("wxyz"))["footer"] == ["Source: a/b 1", "Authors: w, x, y and others"]
    reg = R.Registry()
    reg.register("b", list)
    reg.register("a", dict)
    assert reg.names() == ["a", "b"] and reg.get("a") is dict
    with pytest.raises(ValueError):
        reg.register("a", list)
