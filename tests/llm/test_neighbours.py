import datetime as dt

import numpy as np
import pytest

from graphloom.llm import neighbours as N

VECTORS = "id string, embedder_id string, vector array<float>, embedded_at timestamp, grp string, vec string"
CONFIGS = "embedder_id string, dimensions int, dim int"


def brute(rows, dims, k=5, least=None):
    """All answers by full comparison, over the latest usable row of each id."""
    latest = {}
    for i, e, v, at, *_ in rows:
        if v is None or len(v) != dims[e] or not np.isfinite(v).all() or not np.any(v):
            continue
        if (e, i) not in latest or at > latest[e, i][0]:
            latest[e, i] = (at, np.asarray(v, np.float32).astype(np.float64))
    out = set()
    for e in dims:
        ids = sorted(i for x, i in latest if x == e)
        if len(ids) < 2:
            continue
        x = np.stack([latest[e, i][1] / np.linalg.norm(latest[e, i][1]) for i in ids]).astype(np.float32)
        s = x @ x.T
        np.fill_diagonal(s, -2)
        for a, row in enumerate(s):
            order = sorted(range(len(ids)), key=lambda b: (-round(float(row[b]), 5), ids[b]))
            out |= {(e, ids[a], ids[b]) for b in order[:k] if b != a and (least is None or row[b] >= least)}
    return out


def clustered(rng, n, d, clusters):
    centres = rng.standard_normal((clusters, d))
    return centres[rng.integers(0, clusters, n)] + 0.25 * rng.standard_normal((n, d))


def table(spark, rows):
    return spark.createDataFrame([(i, e, None if v is None else [float(x) for x in v], at, "g", "v") for i, e, v, at in rows], VECTORS)


@pytest.mark.parametrize("params, least_recall", [(N.Params(rows_per_part=150, sample=1000), 0.95), (N.Params(rows_per_part=60, max_parts=4, sample=600, block=100), 0.9)])
def test_recall_against_brute_force(spark, params, least_recall):
    rng, day = np.random.default_rng(5), dt.datetime(2025, 1, 1)
    rows = [(f"v{i:05d}", "e1", v, day) for i, v in enumerate(clustered(rng, 1500, 16, 40))] + [(f"v{i:05d}", "e2", v, day) for i, v in enumerate(clustered(rng, 300, 8, 6))]
    got = {(r["embedder_id"], r["id"], r["other"]) for r in N.most_similar(table(spark, rows), spark.createDataFrame([("e1", 16, 1), ("e2", None, 1)], CONFIGS), params=params).collect()}
    want = brute(rows, {"e1": 16, "e2": 8})
    assert len(got & want) / len(want) >= least_recall
    assert max(np.bincount([int(i[1:]) for e, i, _ in got if e == "e1"])) <= 5


def test_copies_ties_and_unusable_rows(spark):
    day = lambda n: dt.datetime(2025, 1, n)
    rows = [(f"c{i:02d}", "e", [1.0 + i % 3, 0.0], day(1)) for i in range(0)]
    rows += [(f"c{i:02d}", "e", [2.0, 0.0, 0.0], day(1)) for i in range(12)]  # more copies than answers
    rows += [("p1", "e", [0.0, 3.0, 0.0], day(1)), ("p2", "e", [0.0, 6.0, 0.0], day(1)), ("q", "e", [0.0, 1.0, 1.0], day(2)), ("q", "e", [9.0, 9.0, 9.0], day(1)), ("q", "e", [0.0, 1.0, 1.0], day(2))]
    rows += [("u1", "e", None, day(1)), ("u2", "e", [1.0, 2.0], day(1)), ("u3", "e", [0.0, 0.0, 0.0], day(1)), ("u4", "e", [float("nan"), 1.0, 1.0], day(1)), ("u5", "e", [float("inf"), 1.0, 1.0], day(1)), ("u6", None, [1.0, 1.0, 1.0], day(1)), ("alone", "f", [1.0], day(1))]
    found = N.most_similar(table(spark, rows), spark.createDataFrame([("e", 3, 0), ("g", 9, 0)], CONFIGS))
    got = {(r["embedder_id"], r["id"], r["other"]) for r in found.collect()}
    assert got == brute([r for r in rows if r[1]], {"e": 3, "f": 1})
    pairs = {tuple(r) for r in N.similar_pairs(found).collect()}
    assert all(a < b for _, a, b in pairs) and ("e", "p1", "p2") in pairs


def test_minimum_similarity_and_empty_tables(spark):
    rng, day = np.random.default_rng(6), dt.datetime(2025, 1, 1)
    rows = [(f"v{i}", "e", v, day) for i, v in enumerate(clustered(rng, 200, 8, 20))]
    got = {(r["embedder_id"], r["id"], r["other"]) for r in N.most_similar(table(spark, rows), spark.createDataFrame([], CONFIGS), 0.8).collect()}
    assert got == brute(rows, {"e": 8}, least=0.8)
    assert N.most_similar(table(spark, []), spark.createDataFrame([], CONFIGS)).count() == 0


def test_parts_are_balanced_and_the_classifier_learns_them():
    rng = np.random.default_rng(1)
    x = clustered(rng, 2000, 12, 30).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = N.neighbour_graph(x, 8)
    labels = N.balanced_parts(x, graph, 8)
    size = np.bincount(labels, minlength=8)
    assert size.sum() == 2000 and size.max() <= 1.1 * 250 + 2
    w, b = N.fit_classifier(x[:1500], np.eye(8, dtype=np.float32)[labels[:1500]], 60)
    assert ((x[1500:] @ w + b).argmax(1) == labels[1500:]).mean() > 0.8  # held out
