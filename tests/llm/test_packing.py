import random
from collections import Counter, defaultdict

import pytest

from graphloom.llm import packing as P

ITEMS = "doc_id bigint, n_tokens bigint, budget_id string, rank int"
BUDGETS = "budget_id string, capacity_tokens int"


@pytest.mark.parametrize("seed", range(30))
def test_plan_holds_every_item_once_within_capacity(seed):
    rng = random.Random(seed)
    capacity = rng.randint(1, 60)
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 300)))
    if seed % 3 == 0:
        counts[rng.randint(1, capacity)] += 10_000  # one length holds nearly everything
    used = Counter()
    for lengths, n in P.plan(capacity, dict(counts)):
        assert n > 0 and sum(lengths) <= capacity
        for x in lengths:
            used[x] += n
    assert used == +counts


@pytest.mark.parametrize("gap, stock, exact", [(5, {5: 1}, True), (5, {2: 1, 3: 1}, True), (6, {1: 1, 2: 1, 3: 1}, True), (6, {3: 1}, False), (6, {3: 2}, True), (6, {2: 3}, True), (6, {2: 2}, False)])
def test_complements(gap, stock, exact):
    s = P.Stock(20, stock | {20 - gap: 1})
    found = s.complement(20 - gap)
    assert (found is not None) == exact and (not exact or sum(found) == gap)


def test_exact_combinations_leave_nothing_unused():
    counts = {7: 100, 3: 100, 4: 50, 2: 50, 1: 200}
    plan = P.plan(10, counts)
    assert sum(n for _, n in plan) == sum(k * v for k, v in counts.items()) // 10


@pytest.mark.parametrize("seed", range(5))
def test_triples_match_brute_force(seed):
    rng = random.Random(seed)
    counts = {x: rng.randint(1, 2) for x in rng.sample(range(1, 60), 12)}
    items = [x for x, n in counts.items() for _ in range(n)]
    sums = {items[i] + items[j] + items[k] for i in range(len(items)) for j in range(i) for k in range(j)}
    stock = P.Stock(200, counts)
    for total in range(3, 180):
        found = stock.triple(total)
        assert (found is not None) == (total in sums)
        assert found is None or (sum(found) == total and stock.fits(found))


def test_plan_of_a_large_capacity_is_quick_and_tight():
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6.5, 1.6, 200_000).astype(int), 1, 131_072)
    kinds, n = np.unique(lengths, return_counts=True)
    began = time.perf_counter()
    plan = P.patterns(131_072, dict(zip(kinds.tolist(), n.tolist())))
    assert time.perf_counter() - began < 10
    used = Counter()
    for held, times in plan:
        assert sum(x * k for x, k in held) <= 131_072
        for x, k in held:
            used[x] += k * times
    assert used == dict(zip(kinds.tolist(), n.tolist()))
    assert sum(times for _, times in plan) <= -(-int(lengths.sum()) // 131_072) + 1


def test_packing_a_table(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 3, 30, 30, 30, 77, 100, 101, 512, None, 0]), "clash", 1) for i in range(600)] + [(5, 30, "", 0), (5, 30, "", 0), (None, 10, "", 0), (9999, 5000, None, None)]
    items = spark.createDataFrame(rows, ITEMS)
    packed = P.pack(items, spark.createDataFrame([("a", 100), ("b", 1000)], BUDGETS)).collect()
    fill, pieces = Counter(), defaultdict(list)
    for r in packed:
        fill[r["budget_id"], r["container_id"]] += r["length"]
        pieces[r["budget_id"], r["doc_id"]].append((r["piece_no"], r["start"], r["length"]))
    want = Counter()
    for i, n, *_ in rows:
        want[i] += n or 0
    for b, capacity in (("a", 100), ("b", 1000)):
        assert all(v <= capacity for (x, _), v in fill.items() if x == b)
        assert sorted({c for x, c in fill if x == b}) == list(range(len({c for x, c in fill if x == b})))
        assert {i: sum(p[2] for p in pieces[b, i]) for i in want} == want
        for i, n, *_ in rows:
            if n and n <= capacity and i not in (5, None):
                assert len(pieces[b, i]) == 1
        assert sorted(pieces[b, 9999]) == [(k, k * capacity, capacity) for k in range(5000 // capacity)]
        assert len([r for r in packed if r["budget_id"] == b]) == sum(max(1, -(-(n or 0) // capacity)) for _, n, *_ in rows)


def test_ranks_are_distinct_and_dense(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 = 0 AS hot", "1 AS k")
    got = P.ranked(df, ["hot"], ["id"], 7).collect()
    for hot in (True, False):
        ranks = sorted(r["rank"] for r in got if r["hot"] == hot)
        assert ranks == list(range(len(ranks)))


def test_empty_tables_and_bad_budgets(spark):
    items, budgets = spark.createDataFrame([], ITEMS), spark.createDataFrame([("a", 10)], BUDGETS)
    assert P.pack(items, budgets).count() == 0
    assert P.pack(spark.createDataFrame([(1, 5, "", 0)], ITEMS), spark.createDataFrame([], BUDGETS)).count() == 0
    for bad in ([("a", 0)], [("a", 1), ("a", 2)], [(None, 3)]):
        with pytest.raises(ValueError):
            P.pack(items, spark.createDataFrame(bad, BUDGETS))
