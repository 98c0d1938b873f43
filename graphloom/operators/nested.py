"""Deeply nested documents as related flat tables, by Merkle subtree identities.

Every container of a JSON body is canonicalised and hashed bottom-up: its identity is the hash of its sorted keys (or places),
its scalars and the identities of the containers it holds, so equal subtrees have equal identities wherever they occur. Objects
are stored once per identity, and so are their links to what they hold; every occurrence in a document is a bridge row. A flat
row is the bridge row of its parent joined with the parent's links.

One pass over the documents writes all three tables; depth is limited by nothing but memory.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import join_hot, written

#: One row of any of the tables: ``bridge`` (document, section, place, parent), ``link`` (holder, place, key, held) or ``object``.
STORE = "row_kind string, document_id bigint, root_id string, section string, pos int, link_key string, object_id string, child_id string, object_kind string, owner string, body string"

#: Keys by which an entry that stands alone, outside any array, is told from a map of entries.
ALONE = {
    "event": {"event", "listeners"},
    "listener": {"kind", "class", "method", "file", "line", "queued", "source"},
    "binding": {"abstract", "concrete"},
    "class": {"source", "kinds", "reflection"},
    "case": {"name"},
}


class Unreadable(ValueError):
    pass


class Exact:
    """A number that neither a float nor a Python integer of usual length holds exactly, by its text."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text

    def __eq__(self, other) -> bool:
        return isinstance(other, Exact) and other.text == self.text

    def __hash__(self) -> int:
        return hash(self.text)


def _constant(name: str):
    raise Unreadable(name)


def _integer(digits: str):
    return int(digits) if len(digits) < 4000 else Exact(digits)


def _fraction(text: str):
    near = float(text)
    if len(text) <= 16 and abs(near) < 1e300 and near != 0:
        return near
    try:
        exact = Decimal(text)
        if abs(near) != float("inf") and exact == Decimal(repr(near)):
            return near
        return Exact(str(exact.normalize()) if len(text) <= 28 else text)
    except InvalidOperation:
        return Exact(text)


_DECODER = json.JSONDecoder(parse_constant=_constant, parse_int=_integer, parse_float=_fraction)
_SPACE = re.compile(r"[ \t\n\r]*")


def read_json(text: str | None):
    """The JSON value of a text; raises Unreadable for null, empty and invalid text. A byte order mark is skipped, no depth is too great."""
    if not isinstance(text, str):
        raise Unreadable("null")
    text = text.lstrip("\ufeff")
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _read_deep(text)
    except ValueError as e:
        raise Unreadable(str(e)) from e


def _read_deep(text: str):
    """The same with a stack of its own."""
    end = len(text)
    space = lambda i: _SPACE.match(text, i).end()
    holders: list[tuple[dict | list, str | None]] = []  # containers not yet closed, each with the key its next value gets

    def key_at(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise Unreadable(f"no key at {i}")
        try:
            key, i = json.decoder.scanstring(text, i + 1, True)
        except ValueError as e:
            raise Unreadable(str(e)) from e
        i = space(i)
        if text[i : i + 1] != ":":
            raise Unreadable(f"no colon at {i}")
        return key, space(i + 1)

    i = space(0)
    while True:
        opener, opened = text[i : i + 1], False
        if opener in ("{", "["):
            value: object = {} if opener == "{" else []
            i = space(i + 1)
            opened = text[i : i + 1] != ("}" if opener == "{" else "]")
            i += not opened
        else:
            try:
                value, i = _DECODER.scan_once(text, i)
            except (StopIteration, ValueError) as e:
                raise Unreadable(str(e)) from e
        if holders:
            holder, key = holders[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
        else:
            root = value
        if opened:
            key = None
            if opener == "{":
                key, i = key_at(i)
            holders.append((value, key))
            continue
        while True:
            i = space(i)
            if not holders:
                if i != end:
                    raise Unreadable(f"more text at {i}")
                return root
            holder = holders[-1][0]
            mark = text[i : i + 1]
            if mark == ",":
                i = space(i + 1)
                if isinstance(holder, dict):
                    key, i = key_at(i)
                    holders[-1] = (holder, key)
                break
            if mark != ("}" if isinstance(holder, dict) else "]"):
                raise Unreadable(f"not closed at {i}")
            holders.pop()
            i += 1


def unwrap(value):
    """A string that is itself the JSON text of an object, array or null, as that value; anything else as it is."""
    while isinstance(value, str) and value.lstrip("﻿ \t\r\n")[:1] in ("{", "[", '"', "n"):
        try:
            inner = read_json(value)
        except Unreadable:
            break
        if not (inner is None or isinstance(inner, (dict, list, str))) or inner == value:
            break
        value = inner
    return value


def places(value, kind: str) -> list[tuple[int, str | None, object]]:
    """(place, key, entry) of a container in any of its spellings, null entries left out.

    Array: index, nulls counted. Map with only numbers as keys: the number. Other map: rank of the key in code point order; so it is
    too if a number exceeds 2,147,483,647, which a place cannot hold.
    An entry outside any container: place 0. A name-keyed enum case with a null value is a case without value, not a null entry.
    """
    value = unwrap(value)
    if value is None:
        return []
    if isinstance(value, list):
        found = [(i, None, unwrap(v)) for i, v in enumerate(value)]
    elif isinstance(value, dict) and value and not (ALONE[kind] & value.keys()):
        if all(k.isascii() and k.isdigit() and (len(k) < 10 or len(k) < 4000 and int(k) <= 0x7FFFFFFF) for k in value):
            found = [(int(k), None, unwrap(v)) for k, v in value.items()]
        else:
            found = [(i, k, unwrap(value[k])) for i, k in enumerate(sorted(value))]
            if kind == "case":
                found = [(i, k, {"name": k, "value": v} if not isinstance(v, dict) else {"name": k} | v) for i, k, v in found]
    elif isinstance(value, dict) and not value:
        found = []
    else:
        found = [(0, None, value)]
    return [x for x in found if x[2] is not None]


def _exact(value):
    """How ``json`` writes a number it cannot hold: marked by control characters, see ``canonical``."""
    return f"\x00{value.text}\x00"


_MARKED = re.compile(r'"\\u0000([-+.0-9eE]+)\\u0000"')


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; equal for equal values."""
    try:
        text = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=_exact)
    except RecursionError:
        text = _canonical_deep(value)
    text = _MARKED.sub(r"\1", text) if "\\u0000" in text else text
    return text if storable(text) else _LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


_LONE = re.compile("[\ud800-\udfff]")


def storable(text: str) -> bool:
    """Whether a text can be written as UTF-8; half of a surrogate pair cannot."""
    return text.isascii() or not _LONE.search(text)


def _canonical_deep(value) -> str:
    out: list[str] = []
    todo: list = [value]
    while todo:
        at = todo.pop()
        if isinstance(at, _Piece):
            out.append(at.text)
        elif isinstance(at, dict) and at:
            parts: list = [_Piece("{")]
            for i, k in enumerate(sorted(at)):
                parts += [_Piece(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":"), at[k]]
            todo += reversed([*parts, _Piece("}")])
        elif isinstance(at, list) and at:
            parts = [_Piece("[")]
            for i, v in enumerate(at):
                parts += [_Piece(",")] * (i > 0) + [v]
            todo += reversed([*parts, _Piece("]")])
        else:
            out.append(json.dumps(at, ensure_ascii=False, default=_exact))
    return "".join(out)


class _Piece:
    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


def shallow(value, ids: dict[int, tuple[str, object]]):
    """A value with the containers it holds replaced by ``{"#": identity}``. Nothing else in it is an object, so the form is unambiguous."""
    if isinstance(value, dict):
        return {k: {"#": ids[id(v)][0]} if isinstance(v, (dict, list)) else v for k, v in value.items()}
    if isinstance(value, list):
        return [{"#": ids[id(v)][0]} if isinstance(v, (dict, list)) else v for v in value]
    return value


def _encoder():
    """JSON text with sorted keys, in one call: building an encoder for every object would cost more than its hash."""
    make = json.encoder.c_make_encoder
    if make is None:
        return json.JSONEncoder(sort_keys=True, separators=(",", ":"), default=_exact).encode
    encode = make(None, _exact, json.encoder.encode_basestring_ascii, None, ":", ",", True, False, True)
    return lambda value: "".join(encode(value, 0))


_ENCODE = _encoder()


class Subtrees:
    """The identities of the values of one document; each container is hashed once, after those it holds."""

    def __init__(self) -> None:
        self.ids: dict[int, tuple[str, object]] = {}  # the value is kept, so that its id stays its own

    def identity(self, value) -> str:
        if not isinstance(value, (dict, list)):
            return self._hashed(value)
        try:
            return self._of(value)
        except RecursionError:
            return self._of_deep(value)

    def _hashed(self, form) -> str:
        return hashlib.blake2b(_ENCODE(form).encode(), digest_size=16).hexdigest()

    def _of(self, at) -> str:
        known = self.ids.get(id(at))
        if known:
            return known[0]
        form = at
        if type(at) is dict:
            for k, v in at.items():
                if type(v) is dict or type(v) is list:
                    if form is at:
                        form = dict(at)
                    form[k] = {"#": self._of(v)}
        else:
            for i, v in enumerate(at):
                if type(v) is dict or type(v) is list:
                    if form is at:
                        form = list(at)
                    form[i] = {"#": self._of(v)}
        found = self._hashed(form)
        self.ids[id(at)] = (found, at)
        return found

    def _of_deep(self, value) -> str:
        """The same with a stack of its own, whatever the depth."""
        todo = [value]
        while todo:
            at = todo[-1]
            if id(at) not in self.ids:
                held = [v for v in (at.values() if isinstance(at, dict) else at) if isinstance(v, (dict, list)) and id(v) not in self.ids]
                if held:
                    todo += held
                    continue
                self.ids[id(at)] = (self._hashed(shallow(at, self.ids)), at)
            todo.pop()
        return self.ids[id(value)][0]


def identity(value) -> str:
    """The Merkle identity of a JSON value: equal for equal values, whatever the order of their keys."""
    return Subtrees().identity(value)


def _get(value, key: str):
    value = unwrap(value)
    return unwrap(value.get(key)) if isinstance(value, dict) else None


def parents_of(body) -> Iterator[tuple[str, int, str, str | None, object]]:
    """(section, place, kind, name, object) of the event entries, bindings and class entries of one parsed document.

    An entry keyed by its name becomes an object that states it, so that what it holds follows from the object alone.
    """
    sections = _get(body, "sections")
    events = _get(sections, "events")
    for section in ("listeners", "wildcards"):
        for pos, key, entry in places(_get(events, section), "event"):
            if isinstance(entry, dict) and (key is None or ALONE["event"] & entry.keys()):
                if key is not None and "event" not in entry:
                    entry = entry | {"event": key}
            elif key is not None or isinstance(entry, list):  # keyed by the event's name: the entry holds the listeners themselves
                entry = {"event": key, "listeners": entry}
            else:
                continue
            yield section, pos, "event", _name(entry.get("event")), entry
    for pos, key, entry in places(_get(_get(sections, "bindings"), "bindings"), "binding"):
        bound = entry if isinstance(entry, dict) and ALONE["binding"] & entry.keys() else {"abstract": key, "concrete": entry}
        if key is not None and bound.get("abstract") is None:
            bound = bound | {"abstract": key}
        yield "bindings", pos, "binding", _name(bound.get("abstract")), bound
    for pos, key, entry in places(_get(_get(sections, "classes"), "items"), "class"):
        reflection = _get(entry, "reflection")
        if reflection is None and key is not None and isinstance(entry, dict) and "cases" in entry:
            reflection = entry
        name = _get(reflection, "name")
        if key is not None and isinstance(reflection, dict) and (reflection is entry or not isinstance(name, str)):
            entry = {"name": name if isinstance(name, str) else key, "reflection": reflection}
        yield "cases", pos, "class", _name(name if isinstance(name, str) else key), entry


def children_of(kind: str, parent) -> Iterator[tuple[int, str, object]]:
    """(place, kind, object) of what a parent holds: listeners of an event entry, cases of a class entry; a binding stands for itself."""
    if kind == "binding":
        yield 0, "binding", parent
    elif kind == "event":
        for pos, _, listener in places(parent.get("listeners"), "listener"):
            yield pos, "listener", listener
    else:
        for pos, _, case in places(_get(_get(parent, "reflection"), "cases"), "case"):
            yield pos, "case", case


def _name(value) -> str | None:
    return _LONE.sub("\ufffd", value) if isinstance(value, str) else None


def occurrences(body) -> Iterator[tuple[str, int, str, str | None, object, int, object]]:
    """(section, parent place, parent kind, parent name, parent object, child place, child object) of one parsed document."""
    for section, pos, kind, name, parent in parents_of(body):
        for child, _, value in children_of(kind, parent):
            yield section, pos, kind, name, parent, child, value


#: Identities a task remembers to have written; what it forgets it writes again, and the reader merges.
REMEMBERED = 500_000


def _store(wanted: frozenset[str]):
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in STORE.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        out: list[dict] = []
        for batch in batches:
            for doc, text in zip(batch.column("document_id").to_pylist(), batch.column("body").to_pylist()):
                try:
                    body = unwrap(read_json(text))
                except Unreadable:
                    continue
                trees = Subtrees()
                root = trees.identity(body) if "root" in wanted else None
                for section, pos, kind, name, parent in parents_of(body):
                    parent_id = trees.identity(parent)
                    out.append({"row_kind": "bridge", "document_id": doc, "root_id": root, "section": section, "pos": pos, "object_id": parent_id, "object_kind": kind, "owner": name})
                    if (key := kind + parent_id) in seen:
                        continue
                    seen.add(key)
                    held = list(children_of(kind, parent))
                    out += [{"row_kind": "link", "object_id": parent_id, "object_kind": kind, "pos": p, "child_id": trees.identity(v)} for p, _, v in held]
                    if "object" not in wanted:
                        continue
                    for k, value in [(kind, parent), *((k, v) for _, k, v in held if k != "binding")]:
                        if k == kind or (key := k + trees.identity(value)) not in seen:
                            seen.add(key)
                            out.append({"row_kind": "object", "object_id": trees.identity(value), "object_kind": k, "body": canonical(value if k != "class" else shallow(value, trees.ids))})
                    if kind == "class":
                        out += _inner(parent, trees, seen)
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
                if len(seen) > REMEMBERED:
                    seen.clear()
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _inner(parent, trees: Subtrees, seen: set[str]) -> list[dict]:
    """Everything below a class entry: each distinct object or array once, and who holds it under which key or place."""
    out, todo = [], [parent]
    while todo:
        at = todo.pop()
        at_id = trees.identity(at)
        for pos, (key, value) in enumerate(sorted(at.items()) if isinstance(at, dict) else enumerate(at)):
            if not isinstance(value, (dict, list)):
                continue
            held = trees.identity(value)
            out.append({"row_kind": "inner", "object_id": at_id, "pos": pos, "link_key": _name(key), "child_id": held})
            if (mark := "value" + held) not in seen:
                seen.add(mark)
                out.append({"row_kind": "object", "object_id": held, "object_kind": "object" if isinstance(value, dict) else "array", "body": canonical(shallow(value, trees.ids))})
                todo.append(value)
    return out


def latest_documents(docs: DataFrame, key: str = "document_id", at: str = "received_at") -> DataFrame:
    """(key, body): the row of each document with the latest ``at``; a null time is the oldest, equal times go to the greater body hash.

    The rank filter is applied before the shuffle as well, so many deliveries of one document do not meet in one task.
    """
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.xxhash64("body").desc(), F.col("body").desc())
    return docs.select(key, at, "body").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "body")


def subtree_store(docs: DataFrame, *wanted: str) -> DataFrame:
    """The bridge, link and (if ``wanted`` names "object") object rows of the latest readable body of each document, written once.

    "root" adds the identity of whole bodies to the bridge. Unreadable bodies (null, empty, invalid) give no rows; extra columns
    of ``docs`` are ignored; documents without an id count as one document with a null id.
    """
    return written(latest_documents(docs).select(F.col("document_id").cast("bigint").alias("document_id"), "body").mapInArrow(_store(frozenset(wanted)), STORE))


def bridge(store: DataFrame) -> DataFrame:
    """(document_id, root_id, section, parent_pos, object_kind, parent_id, owner): each event entry, binding and class entry of each document."""
    return store.where("row_kind = 'bridge'").select("document_id", "root_id", "section", F.col("pos").alias("parent_pos"), "object_kind", F.col("object_id").alias("parent_id"), "owner")


def links(store: DataFrame) -> DataFrame:
    """(parent_id, object_kind, child_pos, child_id), each once: what the parents hold, whatever documents they stand in."""
    return store.where("row_kind = 'link'").select(F.col("object_id").alias("parent_id"), "object_kind", F.col("pos").alias("child_pos"), "child_id").distinct()


def inner_links(store: DataFrame) -> DataFrame:
    """(parent_id, ordinal, key, child_id), each once: which object or array below a class entry holds which."""
    return store.where("row_kind = 'inner'").select(F.col("object_id").alias("parent_id"), F.col("pos").alias("ordinal"), F.col("link_key").alias("key"), "child_id").distinct()


def objects(store: DataFrame) -> DataFrame:
    """(object_id, object_kind, body), each object once, as canonical JSON; ``object_kind`` lists the parts it plays.

    Class entries and what lies below them are stored with the objects they hold as ``{"#": identity}``; what is a listener,
    case, binding or event entry anywhere is stored whole.
    """
    rows = store.where("row_kind = 'object'").select("object_id", "object_kind", "body")
    least = F.min(F.struct(F.col("object_kind").isin("class", "object", "array").alias("held"), "body"))["body"].alias("body")
    return rows.groupBy("object_id").agg(F.array_join(F.array_sort(F.collect_set("object_kind")), ",").alias("object_kind"), least)


def occurrence_rows(store: DataFrame) -> DataFrame:
    """Bridge rows joined with the links of their parents: one row per listener, wildcard listener, binding and enum case."""
    held = links(store).withColumn("holder", F.concat("object_kind", "parent_id")).drop("object_kind", "parent_id")
    return join_hot(bridge(store).withColumn("holder", F.concat("object_kind", "parent_id")), held, "holder").drop("holder", "object_kind")


def bridge_rows(docs: DataFrame) -> DataFrame:
    """(document_id, root_id, section, parent_pos, parent_id, child_pos, child_id) of every listener, wildcard listener, binding and case."""
    return occurrence_rows(subtree_store(docs, "root")).drop("owner")


def found_rows(docs: DataFrame) -> DataFrame:
    """(document_id, section, parent_pos, child_pos): the places alone, through the same bridge and links."""
    return occurrence_rows(subtree_store(docs)).select("document_id", "section", "parent_pos", "child_pos")


def object_rows(docs: DataFrame) -> DataFrame:
    """Each distinct object once, see ``objects``."""
    return objects(subtree_store(docs, "object"))


def _flat(docs: DataFrame, sections: list[str], owner: str) -> DataFrame:
    store = subtree_store(docs, "object")
    rows = occurrence_rows(store).where(F.col("section").isin(sections)).withColumnRenamed("owner", owner)
    children = objects(store).select(F.col("object_id").alias("child_id"), "body")
    return join_hot(written(rows), children, "child_id", "left")


def _text(path: str) -> F.Column:
    return F.get_json_object("body", path)


def listener_table(docs: DataFrame) -> DataFrame:
    """Flat listeners: document, section, places, event, then the listener's own fields. ``Class@method`` text is taken apart."""
    rows = _flat(docs, ["listeners", "wildcards"], "event")
    plain = F.when(~F.col("body").startswith("{"), F.get_json_object(F.concat(F.lit('{"v":'), "body", F.lit("}")), "$.v"))
    return rows.select(
        "document_id", "section", "parent_pos", "child_pos", "event",
        F.coalesce(_text("$.kind"), F.when(plain.isNotNull(), F.lit("class"))).alias("kind"),
        F.coalesce(_text("$.class"), F.split_part(plain, F.lit("@"), F.lit(1))).alias("class"),
        F.coalesce(_text("$.method"), F.nullif(F.split_part(plain, F.lit("@"), F.lit(2)), F.lit(""))).alias("method"),
        _text("$.file").alias("file"),
        _text("$.line").try_cast("int").alias("line"),
        _text("$.queued").try_cast("boolean").alias("queued"),
        _text("$.source").alias("source"),
        "parent_id", "child_id",
    )


def binding_table(docs: DataFrame) -> DataFrame:
    """Flat bindings: document, place, abstract, shared and the concrete's fields; a concrete given as text is a class name."""
    rows = _flat(docs, ["bindings"], "abstract")
    concrete = _text("$.concrete")
    nested = concrete.startswith("{")
    return rows.select(
        "document_id", "parent_pos", "abstract",
        _text("$.shared").try_cast("boolean").alias("shared"),
        F.when(nested, _text("$.concrete.kind")).otherwise(F.when(concrete.isNotNull(), F.lit("class"))).alias("concrete_kind"),
        F.when(nested, _text("$.concrete.class")).otherwise(concrete).alias("concrete_class"),
        F.when(nested, _text("$.concrete.file")).alias("concrete_file"),
        F.when(nested, _text("$.concrete.line")).try_cast("int").alias("concrete_line"),
        "child_id",
    )


def case_table(docs: DataFrame) -> DataFrame:
    """Flat enum cases: document, places, class, case name, value as text and the value's JSON type."""
    rows = _flat(docs, ["cases"], "class")
    value = F.try_variant_get(F.try_parse_json("body"), "$.value", "variant")
    plain = F.when(~F.col("body").startswith("{"), F.get_json_object(F.concat(F.lit('{"v":'), "body", F.lit("}")), "$.v"))
    kind = F.lower(F.schema_of_variant(value))
    return rows.select(
        "document_id", "parent_pos", "child_pos", "class",
        F.coalesce(_text("$.name"), plain).alias("case_name"),
        _text("$.value").alias("case_value"),
        F.when(kind == "string", "string").when(kind == "boolean", "boolean").when(kind.isin("bigint", "double") | kind.startswith("decimal"), "number").alias("value_type"),
        "parent_id", "child_id",
    )
