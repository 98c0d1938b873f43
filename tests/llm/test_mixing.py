import pytest

from graphloom.llm import mixing as M

DOCS = "doc_id bigint, source string, n_tokens bigint, rate string, cap string, seed string"
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, n=3000):
    spelled = ["Wiki", "wiki ", "WIKI"]
    rows = [(i, spelled[i % 3] if i % 3 else "code-text", 1 + i % 17, "x", "x", "x") for i in range(n)]
    rows += [(10_000 + i, "tiny", 50, "x", "x", "x") for i in range(10)] + [(20_000, None, 5, "", "", ""), (20_001, "other", 5, "", "", ""), (20_002, "tiny", None, "", "", ""), (20_003, "tiny", 0, "", "", "")]
    return spark.createDataFrame(rows, DOCS)


def test_shares_are_reached_within_the_caps(spark):
    targets = spark.createDataFrame([("wiki", 0.5, 1), ("Code_Text", 0.3, 2), ("tiny", 0.2, 5), ("absent", 0.4, 3)], TARGETS)
    table = docs(spark)
    mixed = M.mix(table, targets)
    report = {r["source"]: r for r in M.share_report(table, targets, mixed).collect()}
    for source, share in (("wiki", 0.5), ("code_text", 0.3), ("tiny", 0.2)):
        assert report[source]["actual_share"] == pytest.approx(share, abs=0.01)
    assert report["absent"]["actual_share"] == report["other"]["actual_share"] == report[None]["actual_share"] == 0
    assert report["tiny"]["copies"] == 50
    copies = {}
    for r in mixed.collect():
        copies.setdefault(r["doc_id"], []).append(r["copy_no"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    assert all(len(c) <= 5 for c in copies.values()) and not {20_000, 20_001, 20_002, 20_003} & copies.keys()
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, M.mix(table, targets).collect()))  # the coins are seeded


def test_rates():
    t = [M.Target("a", 0.5, 2), M.Target("b", 0.5, 10), M.Target("c", 0.2, 0)]
    assert M.repetition_rates(t, {"a": 100, "b": 10}) == {"a": 1.0, "b": 10.0}
    assert M.repetition_rates(t, {"a": 100, "b": 10}, total=20) == {"a": 0.1, "b": 1.0}
    assert M.repetition_rates(t, {"a": 100}) == {"a": 2.0}
    assert M.repetition_rates(t, {}) == {}


def test_empty_tables(spark):
    none = spark.createDataFrame([], TARGETS)
    assert M.mix(docs(spark, 10), none).count() == 0
    assert M.mix(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, None)], TARGETS)).count() == 0
