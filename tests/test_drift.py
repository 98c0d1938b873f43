import datetime as dt
import json
import random

import pytest

from graphloom.operators import drift as D

SCHEMA = "file_id bigint, doc_kind string, stream_key string, written_at timestamp, body string, field string"


def brute(files):
    """The changes of one stream's files in order, by the plain rules."""
    kind = lambda v: "boolean" if isinstance(v, bool) else {str: "string", dict: "object", list: "array"}.get(type(v), "number")
    empty = lambda v: v is None or v in ("", {}, [])
    text = lambda v: v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False)
    out, before, history = [], None, {}
    for file_id, body in files:
        if before is not None:
            gone, new = sorted(set(before) - set(body)), sorted(set(body) - set(before))
            moved = {}
            for g in gone:
                partner = next((n for n in new if n not in moved and not empty(body[n]) and not empty(before[g]) and text(body[n]) == text(before[g])), None)
                if partner is None:
                    out.append((file_id, g, "removed"))
                    history.pop(g, None)
                else:
                    moved[partner] = g
            for n in new:
                out.append((file_id, n, "renamed" if n in moved else "added"))
            carried = {n: history.pop(g) for n, g in moved.items() if g in history}
            for n in new:
                history.pop(n, None)
            history |= carried
        for f, v in body.items():
            if not empty(v):
                if history.get(f, kind(v)) != kind(v):
                    out.append((file_id, f, "retyped"))
                history[f] = kind(v)
        before = body
    return sorted(out)


def rows(df):
    return sorted((r["file_id"], r["field"], r["change"]) for r in df.select("file_id", "field", "change").collect())


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("partitions", [1, 5])
def test_random_streams_match_brute_force_however_they_are_split(spark, seed, partitions):
    rng = random.Random(seed)
    values = [None, "", "1", 1, True, [], [1], {}, {"a": 1}, "x", 2.5]
    table, want, i = [], [], 0
    for key in ("s1", "s2", None):
        files = []
        for _ in range(40 if key == "s1" else rng.randint(1, 6)):
            i += 1
            body = {f: rng.choice(values) for f in rng.sample("abcdef", rng.randint(0, 5))}
            table.append((i, "project_meta", key, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=i), json.dumps(body), "clash"))
            files.append((i, body))
        want += brute(files)
    table += [(1000, "project_meta", "s1", dt.datetime(2025, 1, 1), "{bad", ""), (1001, "project_meta", "s1", dt.datetime(2025, 1, 1), "[]", ""), table[3], table[3]]
    rng.shuffle(table)
    assert rows(D.schema_changes(spark.createDataFrame(table, SCHEMA), partitions)) == sorted(want)


def test_nested_objects_of_global_config(spark):
    at = lambda i: dt.datetime(2025, 1, i)
    table = [(1, "global_config", "m", at(1), '{"a": {"x": 1, "y": {}}, "b": {}}', ""), (2, "global_config", "m", at(2), '{"a": {"z": 1, "y": {"q": 2}}, "b": {"k": true}}', "")]
    assert rows(D.schema_changes(spark.createDataFrame(table, SCHEMA))) == [(2, "a.z", "renamed"), (2, "b", "removed"), (2, "b.k", "added")]


def test_alternatives_and_consistent_table(spark):
    at = lambda i: dt.datetime(2025, 1, i)
    table = [
        (1, "project_meta", "p", at(1), '{"n": 1, "old": "v", "a.b": true, "file_id": "q"}', ""),
        (2, "project_meta", "p", at(2), '{"n": "2", "new": "v", "a.b": false}', ""),
        (3, "project_meta", "p", at(3), "", ""),
    ]
    files = spark.createDataFrame(table, SCHEMA)
    assert {(r["field"], r["tag"], r["alternative_no"]) for r in D.alternatives(files).collect() if r["field"] == "n"} == {("n", "number", 1), ("n", "string", 2)}
    got = {r["file_id"]: r.asDict() for r in D.consistent_table(files, "project_meta").collect()}
    assert got[1]["n"] == "1" and got[1]["n__number"] == 1 and got[1]["n__string"] is None and got[2]["n__string"] == "2"
    assert got[1]["new"] == got[2]["new"] == "v" and "old" not in got[1]
    assert got[1]["a_b"] is True and got[1]["file_id_2"] == "q" and set(got) == {1, 2}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert D.schema_changes(empty).count() == 0 and D.consistent_table(empty, "project_meta").count() == 0


def test_canonical_names():
    assert D.canonical_names([("a", "b", 3), ("b", "c", 2), ("a", "x", 1)]) == {"a": "c", "b": "c"}
    assert D.canonical_names([("b", "a", 1), ("a", "b", 1)]) == {"b": "a"}


def one_kind(spark, *bodies):
    at = dt.datetime(2025, 1, 1)
    files = spark.createDataFrame([(i + 1, "project_meta", "p", at + dt.timedelta(days=i), b, "") for i, b in enumerate(bodies)], SCHEMA)
    return {r["file_id"]: r.asDict() for r in D.consistent_table(files, "project_meta").collect()}


def test_old_and_final_name_in_one_file_both_keep_their_value(spark):
    got = one_kind(spark, '{"a": "v"}', '{"b": "v"}', '{"a": "w"}', '{"b": "w"}', '{"a": 1, "b": 2}', '{"a": 1, "b": 3}')
    assert [(got[i]["a"], got[i]["b"]) for i in range(1, 7)] == [(None, "v"), (None, "v"), (None, "w"), (None, "w"), (1, "2"), (1, "3")]


def test_numbers_stay_exact(spark):
    big = "123456789012345678901234567890"
    bodies = [f'{{"id": 9007199254740993, "f": 0.25, "big": {big}, "mix": 9007199254740993, "huge": {"7" * 50}, "long": 0.1234567890123456789}}', '{"id": -5, "f": 3, "big": 1, "mix": 0.5, "huge": 1, "long": 1.5}']
    got = one_kind(spark, *bodies)
    assert got[1]["id"] == 9007199254740993 and got[2]["id"] == -5 and int(got[1]["big"]) == int(big)
    assert got[1]["f"] == 0.25 and got[2]["f"] == 3.0 and isinstance(got[2]["f"], float)
    assert got[1]["mix"] == "9007199254740993" and got[2]["mix"] == "0.5" and got[1]["huge"] == "7" * 50
    assert got[1]["long"] == "0.1234567890123456789" and got[2]["long"] == "1.5"


def test_alternatives_at_any_depth(spark):
    at = dt.datetime(2025, 1, 1)
    table = [(1, "project_meta", "p", at, '{"a": {"b": [1, "x", {"c": true}]}, "e": null}', ""), (2, "project_meta", "p", at, '{"a": {"b": 5}}', "")]
    got = {(r["field"], r["tag"], r["files"]) for r in D.alternatives(spark.createDataFrame(table, SCHEMA)).collect()}
    assert got == {("a", "object", 2), ("a.b", "array", 1), ("a.b", "number", 1), ("a.b[]", "number", 1), ("a.b[]", "string", 1), ("a.b[]", "object", 1), ("a.b[].c", "boolean", 1)}
