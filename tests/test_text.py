import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import retrieval as R
from graphloom.operators import text as T
from helpers import make_graph, method

CODE = """<?php
namespace App\\Shop;

// class Ghost { function no() {} }
/** Orders. */
final class Order extends Base implements Can {
    public const X = "}";
    /** Places it. */
    public function place(int $n): void { if ($n) { $this->x = '{'; } }
    abstract protected function later(): int;
}
function helper($a) { return $a; } # function gone() {}
interface Can { public function go(); }
"""


def test_source_chunks_of_classes_methods_and_functions(spark):
    got = {(k, s): (a, b, body, ns) for k, a, b, body, s, ns in T.source_chunks(CODE)}
    assert set(got) == {("class_header", "App\\Shop\\Order"), ("method", "App\\Shop\\Order::place"), ("method", "App\\Shop\\Order::later"), ("function", "App\\Shop\\helper"), ("interface_header", "App\\Shop\\Can"), ("method", "App\\Shop\\Can::go")}
    a, b, body, _ = got["method", "App\\Shop\\Order::place"]
    assert CODE[a:b] == body and body.startswith("/** Places it. */") and body.endswith("'{'; } }")
    head = got["class_header", "App\\Shop\\Order"][2]
    assert head.startswith("/** Orders. */\nfinal class Order") and "public function place(int $n): void" in head
    assert T.source_chunks("just text") == [("file", 0, 9, "just text", None, None)]
    rows = T.chunk_sources(spark.createDataFrame([("é.php", "é " + CODE, 1), ("n.php", None, 1), ("e.php", "", 1)], "file_path string, text string, id int")).collect()
    assert {r["file_path"] for r in rows} == {"é.php"}
    for r in rows:
        raw = ("é " + CODE).encode()[r["start_byte"] : r["end_byte"]].decode()
        assert r["kind"].endswith("_header") or raw == r["text"]
        assert r["id"] == hashlib.sha1(f"é.php:{r['start_byte']}:{r['end_byte']}".encode()).hexdigest()[:16]
        assert ("é " + CODE).encode()[: r["start_byte"]].decode().count("\n") + 1 == r["start_line"]


def test_paragraphs(spark):
    texts = [(1, "a\nb\n\n \t\nc"), (2, "\n\nx\r\ny\r\n"), (3, ""), (4, None), (5, " \n\t")]
    got = [(r["k"], r["piece_no"], r["start_line"], r["end_line"], r["text"]) for r in T.paragraphs(spark.createDataFrame(texts, "k int, t string"), "k", "t").orderBy("k", "piece_no").collect()]
    assert got == [(1, 0, 1, 2, "a\nb"), (1, 1, 5, 5, "c"), (2, 0, 3, 4, "x\ny")]


def test_read_block(spark):
    day = lambda d: dt.datetime(2025, 1, d)
    files = spark.createDataFrame([("f", "1\r\n2\n3\n4\n", day(2)), ("e", "", day(1))], "file_path string, text string, mtime timestamp")
    asks = spark.createDataFrame([("f", 2, 3, 0, day(1)), ("f", 2, 9, 5, day(3)), ("f", 5, 6, 0, None), ("f", 3, 2, 0, None), ("g", 1, 1, 0, None), ("e", 1, 1, 0, None)], "file_path string, start_line int, end_line int, context_lines int, indexed_at timestamp")
    got = {(r["file_path"], r["content"], r["error_code"], r["truncated_to_eof"], r["stale"]) for r in T.read_block(files, asks).collect()}
    assert got == {("f", "2\n3", None, False, True), ("f", "1\n2\n3\n4", None, True, False), ("f", None, "range_out_of_bounds", False, False), ("f", None, "invalid_range", False, False), ("g", None, "file_not_found", False, False), ("e", None, "range_out_of_bounds", False, False)}


def test_bodies_and_enrichment(spark):
    g = make_graph(spark, [method("C", "m"), method("D", "n"), ("event:E", "event", "E", {})], [("method:C::m", "event:E", "fires"), ("method:D::n", "method:C::m", "calls")])
    schema = "id string, project_slug string, kind string, file_path string, start_byte int, end_byte int, start_line int, end_line int, text string, node_id string, symbol string, indexed_at timestamp"
    day = dt.datetime(2025, 1, 1)
    rows = [("a", "p", "method", "f.php", 50, 60, 5, 6, "later", "method:C::m", "C::m", day), ("b", "p", "method", "f.php", 0, 9, 1, 2, "old", "method:C::m", "C::m", day), ("b", "p", "method", "f.php", 0, 9, 1, 2, "x\r\ny \n", "method:C::m", "C::m", day + dt.timedelta(1)), ("c", "p", "file", "g", 0, 1, 1, 1, None, None, None, None)]
    chunks = spark.createDataFrame(rows, schema)
    body = T.node_bodies(g, chunks).collect()
    assert [(r["node_id"], r["content"], r["chunk_id"]) for r in body] == [("method:C::m", "x\ny \n", "b")]
    text = {r["id"]: r["text"] for r in T.enrich_chunks(g, chunks).collect()}
    assert text["b"] == "method: C::m\nfile: f.php:1-2\nclass: C\nfires: E\ncalled by: D::n\n\nsource:\nx\r\ny" and set(text) == {"a", "b"}


def test_embedding_uses_the_cache(spark):
    calls = []
    e = T.HashingEmbedder(8)
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, "")], "id int, text string")
    cached = spark.createDataFrame([(hashlib.sha256(b"hashing-v1:c").hexdigest(), [1.0] * 8), (hashlib.sha256(b"hashing-v1:").hexdigest(), [1.0])], "key string, vector array<float>")
    vectors, fresh = T.embed_missing(texts, cached, e)
    got = {r["id"]: r["vector"] for r in vectors.collect()}
    assert got[3] == [1.0] * 8 and np.allclose(got[1], e.embed(["a b"])[0]) and got[1] == got[2] and fresh.count() == 2 and not calls


@pytest.mark.parametrize("block, few", [(3, 0), (1000, 0), (3, 4_000)])
def test_top_k_matches_brute_force_with_ties(spark, block, few):
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    rows = [("g" if i % 2 else "h", i, [float(v) for v in x[i]]) for i in range(60)] + [("g", 100, None), ("g", 101, [1.0]), ("g", 102, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "grp string, id int, vec array<double>")
    got = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in R.block_top_k(df, df.where("id % 10 = 1"), 7, block=block, few=few).collect()}
    unit = lambda v: v / np.linalg.norm(v)
    for q in range(1, 60, 10):
        if not x[q].any():
            continue
        scored = sorted(((-round(float(unit(x[q]) @ unit(x[i])), 6), i) for i in range(60) if i % 2 == q % 2 and x[i].any()))[:7]
        assert [got[q, r + 1][0] for r in range(7)] == [i for _, i in scored]
    c = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(R.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [None if r["c"] is None else round(r["c"], 6) for r in c] == [0.707107, None, None]


@pytest.mark.parametrize("few", [0, 4_000])
def test_top_k_keeps_groups_apart_that_differ_behind_a_nul(spark, few):
    df = spark.createDataFrame([(f"p\0{e}", 10 * e + i, [1.0, float(i)]) for e in (1, 2) for i in range(3)], "grp string, id int, vec array<double>")
    rows = R.block_top_k(df, df.where("id % 10 = 0"), 5, few=few).collect()
    assert sorted((r["qid"], r["id"]) for r in rows) == [(q, q + i) for q in (10, 20) for i in range(3)]


def test_semantic_search_reranks_and_counts(spark):
    g = make_graph(spark, [method("C", "m"), ("class:K", "class", "K", {"fqn": "K"})], [])
    schema = "id string, project_slug string, embedder_id string, vector array<float>, payload struct<node_id: string>, embedded_at timestamp"
    v = [("c1", "p", "e", [1.0, 0.0], ("method:C::m",), None), ("c2", "p", "e", [1.0, 0.2], ("method:C::m",), None), ("c3", "p", "e", [1.0, 0.1], ("class:K",), None), ("c4", "p", "e", [1.0, 0.05], ("gone",), None), ("c5", "p", "e", [0.0, 1.0], (None,), None), ("c6", "q", "e", [1.0, 0.0], None, None)]
    vectors = spark.createDataFrame(v, schema)
    hits = R.semantic_search(g, vectors, vectors.where("id = 'c1'")).orderBy("position").collect()
    assert [(h["node_id"], h["kind"], h["chunk_id"]) for h in hits] == [("method:C::m", "method", "c1"), ("class:K", "class", "c3"), ("gone", "chunk", "c4")]
    assert hits[0]["score"] == 1.2 and hits[0]["confidence"] == "high" and hits[0]["filtered"] == 1


def test_upsert_delete_and_orphans(spark):
    t = "id string, v int, at int"
    old, new = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], t), spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 0)], t)
    assert sorted(tuple(r) for r in R.upsert(old, new, ["id"], "at").collect()) == [("a", 1, 0), ("b", 3, 2), ("c", 4, 0)]
    assert [r["id"] for r in R.delete_ids(old, new, ["id"]).collect()] == ["a"] == [r["id"] for r in R.orphans(old, new, ["id"]).collect()]


def test_snippets(spark):
    files = spark.createDataFrame([("a", "1\n2\r\n3\n4\n5\n6\n7\n"), ("e", ""), ("n", None)], "file_path string, text string")
    hits = spark.createDataFrame([("a", 4, 4, "k"), ("a", 1, 9, "k"), ("a", 30, 31, "k"), ("a", None, 2, "k"), ("e", 1, 1, "k"), ("n", 1, 1, "k"), ("m", 1, 1, "k"), (None, 1, 1, "k")], "file_path string, start_line int, end_line int, text string")
    got = {(r["file_path"], r["start_line"]): r["snippet"] for r in T.snippets(hits, files, snippet_lines=5).collect()}
    assert got == {("a", 4): "2\n3\n4\n5\n6", ("a", 1): "1\n2\n3\n4\n5", ("a", 30): "", ("a", None): None, ("e", 1): "", ("n", 1): None, ("m", 1): None, (None, 1): None}
