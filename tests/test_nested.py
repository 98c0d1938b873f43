import json

import pytest

from graphloom.operators import nested as N

SCHEMA = "document_id bigint, received_at timestamp, body string, section string"


def brute(body):
    """Rows of one body, written independently of the operator."""
    rows = []
    s = body.get("sections") or {}
    ev = s.get("events") or {}
    for section in ("listeners", "wildcards"):
        for i, entry in enumerate(ev.get(section) or []):
            for j, x in enumerate((entry or {}).get("listeners") or []):
                if x is not None:
                    rows.append((section, i, j))
    for i, b in enumerate((s.get("bindings") or {}).get("bindings") or []):
        if b is not None:
            rows.append(("bindings", i, 0))
    for i, c in enumerate((s.get("classes") or {}).get("items") or []):
        for j, x in enumerate((((c or {}).get("reflection") or {}).get("cases")) or []):
            if x is not None:
                rows.append(("cases", i, j))
    return sorted(rows)


PLAIN = {
    "sections": {
        "events": {"listeners": [None, {"event": "E", "listeners": [{"class": "A"}, None, "B@handle"]}, {"event": "F", "listeners": []}], "wildcards": [{"event": "a.*", "listeners": [{"class": "A"}]}]},
        "bindings": {"bindings": [{"abstract": "X", "concrete": "Y"}, None, {"abstract": "Z", "concrete": {"class": "W"}}]},
        "classes": {"items": [None, {"reflection": {"name": "En", "cases": [{"name": "A", "value": 1}, None, {"name": "B"}]}}, {"reflection": None}]},
    }
}


def found(spark, rows):
    df = N.bridge_rows(spark.createDataFrame(rows, SCHEMA))
    return sorted((r["section"], r["parent_pos"], r["child_pos"]) for r in df.collect())


def one(spark, body):
    """The walk alone, without Spark; ``test_the_whole_path`` holds both together."""
    try:
        body = N.unwrap(N.read_json(body if isinstance(body, str) or body is None else json.dumps(body)))
    except N.Unreadable:
        return []
    return sorted((section, pos, child) for section, pos, _, _, _, child, _ in N.occurrences(body))


def test_the_whole_path(spark):
    bodies = [PLAIN, {"sections": {"classes": {"items": {"reflection": {"cases": {"3": {"name": "A"}, "10": {"name": "B"}}}}}}}, {"sections": {"events": {"listeners": {"b": ["X@y", None], "a": {"class": "Z"}}}}}]
    texts = [*map(json.dumps, bodies), None, "", "{", "[1, NaN]", "null", "3", '{"sections": 5}']
    df = N.found_rows(spark.createDataFrame([(i, None, t, "clash") for i, t in enumerate(texts)], SCHEMA))
    want = sorted((i, *x) for i, t in enumerate(texts) for x in one(spark, t))
    assert sorted(map(tuple, df.collect())) == want and len(want) == len(brute(PLAIN)) + 4


def test_plain_documents_match_brute_force(spark):
    assert one(spark, PLAIN) == brute(PLAIN)


def test_json_text_at_any_level_and_byte_order_mark(spark):
    s = PLAIN["sections"]
    wrapped = {"sections": json.dumps({"events": json.dumps(s["events"]), "bindings": {"bindings": json.dumps(s["bindings"]["bindings"])}, "classes": json.dumps(s["classes"])})}
    assert one(spark, "﻿" + json.dumps(wrapped)) == brute(PLAIN)


@pytest.mark.parametrize(
    "cases, places",
    [
        ({"3": {"name": "A"}, "10": {"name": "B"}}, [3, 10]),
        ({"b": 1, "a": "x", "B": None}, [0, 1, 2]),
        ({"name": "A", "value": 1}, [0]),
        ([], []),
        ({}, []),
        (None, []),
        ("A", [0]),
        ("null", []),
        ('[{"name": "A"}, null, "null", {"name": "B"}]', [0, 3]),
    ],
)
def test_spellings_of_a_container(spark, cases, places):
    assert one(spark, {"sections": {"classes": {"items": {"reflection": {"cases": cases}}}}}) == [("cases", 0, p) for p in places]


def test_events_keyed_by_name_hold_listeners(spark):
    body = {"sections": {"events": {"listeners": {"b\\E": ["X@y", {"class": "A"}], "a\\E": {"class": "Z"}}}}}
    assert one(spark, body) == [("listeners", 0, 0), ("listeners", 1, 0), ("listeners", 1, 1)]


@pytest.mark.parametrize("body", [None, "", "{", "[1, NaN]", "null", "[]", "3", '{"sections": 5}', '{"sections": {"events": [1]}}'])
def test_unreadable_and_odd_bodies_give_no_rows(spark, body):
    assert one(spark, body) == []


def test_latest_body_counts_even_if_unreadable(spark):
    import datetime as dt

    good = json.dumps(PLAIN)
    assert found(spark, [(1, dt.datetime(2025, 1, 1), good, ""), (1, dt.datetime(2025, 1, 2), "{", "")]) == []
    assert found(spark, [(1, dt.datetime(2025, 1, 3), good, ""), (1, dt.datetime(2025, 1, 2), "{", ""), (1, dt.datetime(2025, 1, 3), good, "")]) == brute(PLAIN)


def test_identities_ignore_key_order_and_objects_are_stored_once(spark):
    assert N.identity({"a": 1, "b": [1, {"c": None}]}) == N.identity({"b": [1, {"c": None}], "a": 1}) != N.identity({"b": [1, {"c": 0}], "a": 1})
    assert N.identity({"a": {"#": "x"}}) != N.identity({"a": "x"}) and N.identity([[]]) != N.identity([])
    docs = spark.createDataFrame([(i, None, json.dumps(PLAIN), "") for i in range(5)], SCHEMA)
    store = N.subtree_store(docs, "root", "object")
    objects = {r["object_id"]: r for r in N.objects(store).collect()}
    assert len(objects) == N.objects(store).count()
    bridge = N.bridge_rows(docs).collect()
    assert len(bridge) == 5 * len(brute(PLAIN)) and len({r["root_id"] for r in bridge}) == 1
    assert {r[c] for r in bridge for c in ("child_id", "parent_id")} <= set(objects)
    for r in objects.values():
        if r["object_kind"].split(",")[0] in ("listener", "case", "binding", "event"):
            assert N.identity(json.loads(r["body"])) == r["object_id"]


def test_documents_come_back_from_their_objects(spark):
    """A class entry is rebuilt from the objects it holds; what differs between two entries of one name keeps them apart."""
    first = {"kinds": ["enum"], "reflection": {"name": "En", "cases": [{"name": "A", "value": 1}], "deep": {"x": [[{"y": 1}]]}}}
    second = first | {"kinds": ["class"]}
    body = json.dumps({"sections": {"classes": {"items": [first, second, first]}}})
    store = N.subtree_store(spark.createDataFrame([(1, None, body, "")], SCHEMA), "object")
    objects = {r["object_id"]: json.loads(r["body"]) for r in N.objects(store).collect()}

    def rebuilt(value):
        if isinstance(value, dict) and value.keys() == {"#"}:
            return rebuilt(objects[value["#"]])
        return {k: rebuilt(v) for k, v in value.items()} if isinstance(value, dict) else [rebuilt(v) for v in value] if isinstance(value, list) else value

    parents = {r["parent_pos"]: r["parent_id"] for r in N.bridge(store).collect()}
    assert [rebuilt({"#": parents[i]}) for i in range(3)] == [first, second, first] and parents[0] == parents[2] != parents[1]
    inner = {(r["parent_id"], r["key"] or r["ordinal"]): r["child_id"] for r in N.inner_links(store).collect()}
    assert objects[inner[parents[0], "reflection"]]["name"] == "En"


@pytest.mark.parametrize("most", [3, 1000])
def test_a_parent_in_most_documents_is_spread(spark, most, monkeypatch):
    import functools

    monkeypatch.setattr(N, "join_hot", functools.partial(N.join_hot, most=most))
    docs = spark.createDataFrame([(i, None, json.dumps(PLAIN), "") for i in range(20)], SCHEMA)
    assert N.bridge_rows(docs).distinct().count() == N.found_rows(docs).count() == 20 * len(brute(PLAIN))
    assert N.listener_table(docs).where("class IS NOT NULL").count() == 60


def test_numbers_keep_their_value():
    values = ["9" * 5000, "8" * 5000, "1e999", "1e1000", "0.1234567890123456789012", "0.12345678901234567", "9007199254740993", "1.0", "1", "1e5"]
    assert len({N.identity(N.read_json(f'{{"a": {v}}}')) for v in values}) == len(values)
    assert N.identity(N.read_json("[0.1]")) == N.identity(N.read_json("[0.10]")) == N.identity(N.read_json("[1e-1]"))
    assert N.canonical(N.read_json('{"b": 1e999, "a": "\\ud800"}')) == '{"a":"\\ud800","b":1E+999}'


@pytest.mark.parametrize("keys, want", [(["2147483647", "3000000"], [3000000, 2147483647]), (["2147483648", "5"], [0, 1]), (["0000000000012", "1"], [1, 12])])
def test_long_numbers_as_keys(spark, keys, want):
    assert one(spark, {"sections": {"classes": {"items": {"reflection": {"cases": {k: {"name": "A"} for k in keys}}}}}}) == [("cases", 0, p) for p in want]


def test_flat_tables_name_their_parents(spark):
    docs = spark.createDataFrame([(7, None, json.dumps(PLAIN), "")], SCHEMA)
    assert {(r["event"], r["class"], r["method"]) for r in N.listener_table(docs).collect()} == {("E", "A", None), ("E", "B", "handle"), ("a.*", "A", None)}
    assert {(r["abstract"], r["concrete_class"]) for r in N.binding_table(docs).collect()} == {("X", "Y"), ("Z", "W")}
    assert {(r["class"], r["case_name"], r["case_value"], r["value_type"]) for r in N.case_table(docs).collect()} == {("En", "A", "1", "number"), ("En", "B", None, None)}


def test_empty_table(spark):
    assert N.bridge_rows(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("depth", [900, 20_000])
def test_deep_bodies_are_not_left_out(spark, depth):
    deep = '{"x": [' * depth + "1" + "]}" * depth
    body = '{"sections": {"bindings": {"bindings": [{"abstract": "A", "concrete": %s}]}, "other": %s}}' % (deep, deep)
    docs = spark.createDataFrame([(1, body, None)], "document_id bigint, body string, received_at timestamp")
    assert [(r["document_id"], r["section"]) for r in N.bridge_rows(docs).collect()] == [(1, "bindings")]
    assert N.object_rows(docs).collect()[0]["body"] == '{"abstract":"A","concrete":' + deep.replace(" ", "") + "}"


@pytest.mark.parametrize("text", ["[1, 2", "[1 2]", '{"a" 1}', '{"a": 1,}', "[1]]", "[,1]", '{1: 2}', "[NaN]", '["\x01"]', "", "[1,"])
def test_the_deep_reader_refuses_what_is_no_json(text):
    with pytest.raises(N.Unreadable):
        N._read_deep(text)


@pytest.mark.parametrize("text", ['{"a": [1, {"b": null}, [], {}], "a": "\\u00e9"}', " [ ] ", '"x"', "[[[]], -1.5e3, true]", '{"k": {"l": [false]}}'])
def test_the_deep_reader_reads_the_same(text):
    assert N._read_deep(text) == json.loads(text) == N.read_json(text)
    assert N._canonical_deep(N.read_json(text)) == N.canonical(N.read_json(text))
