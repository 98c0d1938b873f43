import datetime as dt
import random

import pytest

from graphloom.llm import splitting as S

SCHEMA = "id string, text string, indexed_at timestamp, piece_no string"


def definition(text, limit=1600):
    """The boundary that holds first, word for word."""
    lines = text.split("\n")
    runs, run = [], []
    for line in [*lines, ""]:
        if line.strip(" \t\r") == "":
            if run:
                runs.append("\n".join(run))
            run = []
        else:
            run.append(line)
    size = lambda xs: max((len(x.encode()) for x in xs), default=0)
    if size(runs) <= limit:
        return "blank_line"
    if size(lines) <= limit:
        return "line"
    words = text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
    return "space" if size(words) <= limit else "none"


def random_text(rng, n):
    out = []
    while sum(map(len, out)) < n:
        out.append(rng.choice(["a" * rng.randint(1, 30), "é" * rng.randint(1, 9), "漢" * rng.randint(1, 20), " ", "\t", "\r\n", "\n", "\n\n", "\n \t\n", "🙂"]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_pieces_are_right_and_the_weakest_cut_names_the_boundary(seed):
    rng = random.Random(seed)
    limit, overlap = rng.choice([(16, 3), (40, 10), (64, 0), (8, 7)])
    text = random_text(rng, rng.randint(1, 400))
    data = text.encode()
    pieces = S.split_bytes(data, limit, overlap, block=rng.choice([1, 50, 1 << 18]))
    covered = 0
    for i, (s, e, o, _) in enumerate(pieces):
        assert 0 < e - s <= limit or not data
        data[s:e].decode()  # whole characters
        assert o <= overlap and s == covered - o and e > covered or not data
        assert o == 0 or i
        covered = e
    assert covered == len(data)
    assert b"".join(data[s + o : e] for s, e, o, _ in pieces) == data  # round trip
    if len(data) > limit:
        assert S.NAMES[min(p[3] for p in pieces)] == definition(text, limit)


@pytest.mark.parametrize("seed", range(20))
def test_range_maximum_matches_brute_force(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    v = rng.integers(0, 5, rng.integers(1, 80)).astype(np.int8)
    table = S.RangeMax(v, len(v))
    for lo in range(len(v)):
        for hi in range(lo, len(v)):
            best = max(range(lo, hi + 1), key=lambda i: (v[i], i))
            assert table.query(lo, hi) == best


def test_latest_row_counts_and_odd_rows_do_no_harm(spark):
    day = lambda n: dt.datetime(2025, 1, n)
    long_text = "word " * 700
    rows = [
        ("a", long_text, day(1), "x"), ("a", "short", day(2), "x"),
        ("b", "short", day(1), "x"), ("b", long_text, day(2), "x"), ("b", long_text, day(2), "x"),
        ("c", None, day(1), None), ("d", "", None, None), (None, "y" * 5000, None, None), ("e", "z" * 1600, day(1), None),
    ]
    pieces = S.split_oversized(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for r in pieces.orderBy("id", "piece_no").collect():
        got.setdefault(r["id"], []).append(r)
    assert set(got) == {"b", None}
    assert [p["text"] for p in got["b"]] == [long_text[p["start_byte"] : p["end_byte"]] for p in got["b"]]
    assert {(r["id"], r["boundary"]) for r in S.weakest_boundary(pieces).collect()} == {("b", "space"), (None, "none")}


def test_very_long_text_and_empty_table(spark):
    pieces = S.split_bytes(b"ab " * 400_000, 1600, 160)
    assert all(e - s <= 1600 for s, e, _, _ in pieces) and all(p[3] >= S.SPACE for p in pieces)
    assert S.split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bad_limits():
    for limit, overlap in ((3, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            S.split_bytes(b"x", limit, overlap)


@pytest.mark.parametrize("seed", range(40))
def test_strengths_of_a_stretch_are_those_of_the_whole(seed):
    rng = random.Random(seed)
    data = "".join(rng.choice(["a", "b", " ", "\t", "\n", "\n", "\r\n", "é", "漢"]) for _ in range(rng.randint(0, 60))).encode()
    whole = S.boundary_strengths(data)
    for first in range(len(data) + 1):
        for last in range(first, len(data) + 1):
            assert (S.boundary_strengths(data, first, last) == whole[first : last + 1]).all(), (data, first, last)


@pytest.mark.parametrize("seed", range(10))
def test_pieces_do_not_depend_on_blocks(seed):
    rng = random.Random(seed)
    data = "".join(rng.choice(["word", "x", " ", " ", "\n", "\n\n", " \t\n", "漢"]) for _ in range(3000)).encode()
    assert len({tuple(S.split_bytes(data, 50, 9, block)) for block in (1, 17, 200, 1 << 18)}) == 1


def test_memory_of_a_long_text_is_bounded():
    import tracemalloc

    data = b"some words of a long line without any end " * 250_000
    tracemalloc.start()
    S.split_bytes(data, 1600, 160)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
