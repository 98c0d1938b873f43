import pytest

from graphloom import session as S


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("most", [5, 10_000])
def test_hot_keys_join_like_any_other(spark, how, most):
    rows = [("hot", i) for i in range(40)] + [("rare", 1), ("none", 2), (None, 3)] + [(f"k{i}", i) for i in range(20)]
    left = spark.createDataFrame(rows, "k string, x int")
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("rare", "c"), (None, "d"), ("k3", None)], "k string, y string")
    want = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    assert sorted(map(tuple, S.join_hot(left, right, "k", how, most=most).collect()), key=str) == want
    assert S.join_hot(left.limit(0), right, "k", how, most=most).count() == 0


def test_broadcasts_are_checked(spark):
    marked = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower() or "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert marked(S.broadcast_if_small(spark.range(10), 10)) and not marked(S.broadcast_if_small(spark.range(11), 10))


def test_written_tables_keep_their_schema(spark):
    df = spark.createDataFrame([], "a int, b array<string>")
    assert S.written(df).schema == df.schema and S.written(df).count() == 0
    assert S.shared_dir(spark) == spark.sparkContext.getCheckpointDir().rstrip("/")
