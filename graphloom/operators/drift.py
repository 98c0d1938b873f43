"""Schemas that drift between files: tagged-union inference, one consistent table per kind, and a list of every change.

Each file is read once into the union's form: every field and every path below it with the tag of its type, a field's value with
it. Everything else reads that table. Schemas are fused per part of the files in parallel: files are range-partitioned by
(kind, stream, time), so a stream of any length is spread over many tasks; each task fuses its own run of files, keeping per
field the alternative last seen, and hands over a summary of what its first file needs from before and what its last file leaves
behind; the summaries of one stream (one or two per task it spans, each as large as one file's fields) are then fused in order.
An alternative that appears in a field is reported as a change of type, a field without a counterpart as added or removed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.nested import Exact, Unreadable, canonical, read_json, storable
from graphloom.session import written

STREAM = ["doc_kind", "stream_key"]
FOLDED = "row_kind string, doc_kind string, stream_key string, part int, file_id bigint, field string, change string, old_field string, summary string"
CHANGES = "doc_kind string, stream_key string, file_id bigint, field string, change string, old_field string"
UNION = "file_id bigint, doc_kind string, stream_key string, written_at timestamp, fields array<string>, tags array<string>, vals array<string>, paths array<string>, path_tags array<string>"

#: Kinds whose top-level objects stand for their keys, as ``object.key``.
NESTED_KINDS = ("global_config",)

TAGS = ("string", "number", "boolean", "object", "array")


def tag(value) -> str | None:
    """The JSON type of a non-empty value; None for null, "", {} and []."""
    if value is None or value in ("", {}, []):
        return None
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", dict: "object", list: "array"}.get(type(value), "number")


def as_text(value) -> str:
    """Text without quotes, anything else as JSON with sorted keys."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode()
    if isinstance(value, Exact):
        return value.text
    try:
        text = json.dumps(value, sort_keys=True, ensure_ascii=False)
        return text if storable(text) else canonical(value)
    except (TypeError, RecursionError):  # a number of unusual length, or nested very deeply
        return canonical(value)


def file_object(text: str | None) -> dict | None:
    """The object a file holds; None if it is unreadable or no object."""
    try:
        body = read_json(text)
    except Unreadable:
        return None
    return body if isinstance(body, dict) else None


def fields_of(kind: str, body: dict) -> dict[str, tuple[str | None, str]]:
    """field -> (tag, value as text) of one file."""
    found = {}
    for key, value in body.items():
        if kind in NESTED_KINDS and isinstance(value, dict) and value:
            found |= {f"{key}.{k}": (tag(v), as_text(v)) for k, v in value.items()}
        else:
            found[key] = (tag(value), as_text(value))
    return {as_text(f): v for f, v in found.items()}


def paths_of(body: dict) -> set[tuple[str, str]]:
    """(path, tag) of every non-empty value at any depth: ``.key`` below an object, ``[]`` for the entries of an array."""
    found, todo = set(), [("", body)]
    while todo:
        path, value = todo.pop()
        for key, held in value.items() if isinstance(value, dict) else (("[]", v) for v in value):
            below = path + key if isinstance(value, list) else f"{path}.{key}" if path else key
            if (t := tag(held)) is not None:
                found.add((as_text(below), t))
                if isinstance(held, (dict, list)):
                    todo.append((below, held))
    return found


def compare(before: dict, types: dict, now: dict) -> tuple[list[tuple[str, str, str | None]], dict]:
    """One step of a stream: the changes as (field, change, old name), and the type history carried to the fields of ``now``.

    ``types`` holds, per field of ``before``, the type of its last non-empty value (None if there was none; a tuple stands
    for one that only an earlier task knows).
    """
    gone, new = sorted(before.keys() - now.keys()), sorted(now.keys() - before.keys())
    changes, renamed = [], {}
    free: dict[str, list[str]] = {}
    for name in new:
        if now[name][0] is not None:
            free.setdefault(now[name][1], []).append(name)
    for name in gone:
        partners = free.get(before[name][1]) if before[name][0] is not None else None
        if partners:
            renamed[partners.pop(0)] = name
        else:
            changes.append((name, "removed", None))
    changes += [(name, "renamed" if name in renamed else "added", renamed.get(name)) for name in new]
    return changes, {f: types.get(renamed.get(f, f)) if f in before or f in renamed else None for f in now}


def settle(history: dict, now: dict, changes: list, waiting: list) -> dict:
    """Report fields retyped against their history; where an earlier task knows the history, note it in ``waiting``."""
    types = {}
    for field, (kind, _) in now.items():
        known = history.get(field)
        if kind is not None:
            if isinstance(known, (tuple, list)):
                waiting.append((field, kind, known[1]))
            elif known is not None and known != kind:
                changes.append((field, "retyped", None))
        types[field] = kind if kind is not None else known
    return types


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range partition in order: the changes inside it, and summaries of its first and last stream."""
    part, columns = TaskContext.get().partitionId(), ["row_kind", *STREAM, "part", "file_id", "field", "change", "old_field", "summary"]
    stream, first_stream, before, types, pending, head = None, True, None, {}, [], None

    def summary() -> list:
        s = {"head": head, "pending": pending, "last": before, "types": types}
        return ["summary", *stream, part, None, None, None, None, json.dumps(s)]

    for batch in batches:
        out = []
        for kind, key, file_id, fields, tags, values in zip(*(batch[c] for c in (*STREAM, "file_id", "fields", "tags", "vals"))):
            now = dict(zip(fields, zip(tags, values)))
            file_id = None if pd.isna(file_id) else int(file_id)
            if stream is None or (kind, key) != tuple(stream):
                if stream is not None and head is not None:
                    out.append(summary())
                first_stream = stream is None
                stream, before, types, pending, head = [kind, key], None, {}, [], None
            changes: list = []
            waiting: list = []
            if before is not None:
                changes, history = compare(before, types, now)
                types = settle(history, now, changes, waiting)
                pending += [[file_id, *w] for w in waiting]
            elif first_stream:  # what came before is known to an earlier task, if there was anything
                head = [file_id, now]
                types = {f: t or ("?", f) for f, (t, _) in now.items()}
            else:
                types = {f: t for f, (t, _) in now.items()}
            before = now
            out += [["change", *stream, part, file_id, *c, None] for c in changes]
        frame = pd.DataFrame(out, columns=columns)
        frame["file_id"] = frame["file_id"].astype("Int64")
        yield frame
    if stream is not None:
        yield pd.DataFrame([summary()], columns=columns).astype({"file_id": "Int64"})


def _stitch(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The changes at the seams of one stream, from its tasks' summaries in order."""
    out, before, types = [], None, {}
    for _, text in sorted(zip(frame["part"], frame["summary"])):
        s = json.loads(text)
        known = None
        if s["head"] is not None:
            file_id, now = s["head"]
            changes: list = []
            if before is not None:
                changes, history = compare(before, types, now)
                known = settle(history, now, changes, [])
            else:
                known = {f: t for f, (t, _) in now.items()}
            out += [(*key, file_id, *c) for c in changes]
            out += [(*key, i, f, "retyped", None) for i, f, t, origin in s["pending"] if known.get(origin) not in (None, t)]
        before = s["last"]
        types = {f: (known or {}).get(t[1]) if isinstance(t, list) else t for f, t in s["types"].items()}
    frame = pd.DataFrame(out, columns=[*STREAM, "file_id", "field", "change", "old_field"])
    frame["file_id"] = frame["file_id"].astype("Int64")
    return frame


def one_per_file(files: DataFrame) -> DataFrame:
    """Each file_id once: the row written first (then the smallest body). Files without an id stay apart by kind, stream and time."""
    rows = files.select("file_id", *STREAM, "written_at", "body")
    own = F.when(F.col("file_id").isNull(), F.struct(*STREAM, "written_at")).alias("own")
    least = F.min(F.struct("written_at", *STREAM, "body")).alias("r")
    return rows.groupBy("file_id", own).agg(least).select("file_id", "r.doc_kind", "r.stream_key", "r.written_at", "r.body")


def tagged_union(files: DataFrame) -> DataFrame:
    """The union's form of every readable file, one row each: its fields, their tags (null if empty) and values, and the tags of all paths.

    Unreadable files (null, empty, invalid, no object) have no row; extra columns are ignored.
    """
    kinds = {"file_id": pa.int64(), "written_at": pa.timestamp("us", "UTC")}
    lists = ["fields", "tags", "vals", "paths", "path_tags"]
    schema = pa.schema([*((c, kinds.get(c, pa.string())) for c in ("file_id", *STREAM, "written_at")), *((c, pa.list_(pa.string())) for c in lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("file_id", *STREAM, "written_at", "body"))):
                body = file_object(row[-1])
                if body is not None:
                    fields, paths = fields_of(row[1], body), sorted(paths_of(body))
                    columns = (list(fields), [t for t, _ in fields.values()], [v for _, v in fields.values()], [p for p, _ in paths], [t for _, t in paths])
                    out.append(dict(zip(schema.names, (*row[:-1], *columns))))
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = one_per_file(files).select(F.col("file_id").cast("bigint").alias("file_id"), *STREAM, F.col("written_at").cast("timestamp").alias("written_at"), "body")
    return written(rows.mapInArrow(run, UNION))


def changes_of(union: DataFrame, partitions: int | None = None) -> DataFrame:
    """The changes between consecutive files of a tagged union, see ``schema_changes``."""
    n = partitions or int(union.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*STREAM, "written_at", "file_id"]
    folded = union.select(*order, "fields", "tags", "vals").repartitionByRange(n, *order).sortWithinPartitions(*order)
    folded = written(folded.mapInPandas(_fold, FOLDED))
    seams = folded.where("row_kind = 'summary'").select(*STREAM, "part", "summary").groupBy(*STREAM).applyInPandas(_stitch, CHANGES)
    return folded.where("row_kind = 'change'").select(*STREAM, "file_id", "field", "change", "old_field").unionByName(seams)


def schema_changes(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_kind, stream_key, file_id, field, change, old_field): every field added, removed, renamed or retyped between consecutive files.

    Order within a stream is written_at, then file_id (null times first). Unreadable files are skipped; null kinds and streams
    form streams of their own; extra columns are ignored.
    """
    return changes_of(tagged_union(files), partitions)


def field_values(union: DataFrame) -> DataFrame:
    """The union in long form: one row per file and field, with the value's tag and text (both null if empty)."""
    rows = union.select("file_id", *STREAM, "written_at", F.explode(F.arrays_zip("fields", "tags", "vals")).alias("f"))
    return rows.select("file_id", *STREAM, "written_at", F.col("f.fields").alias("field"), F.col("f.tags").alias("tag"), F.when(F.col("f.tags").isNotNull(), F.col("f.vals")).alias("value"))


def alternatives(files: DataFrame) -> DataFrame:
    """Per kind and path: each type it ever had, in how many files, and when that alternative first appeared.

    ``alternative_no`` counts the types of a path in order of appearance; a number above 1 is a type conflict. Paths name the
    keys from the top, joined by dots, and ``[]`` for the entries of an array; of empty values nothing is known.
    """
    rows = tagged_union(files).select("doc_kind", "written_at", F.explode(F.arrays_zip("paths", "path_tags")).alias("p"))
    seen = rows.groupBy("doc_kind", F.col("p.paths").alias("field"), F.col("p.path_tags").alias("tag"))
    seen = seen.agg(F.count("*").alias("files"), F.min("written_at").alias("first_seen"))
    return seen.withColumn("alternative_no", F.row_number().over(Window.partitionBy("doc_kind", "field").orderBy("first_seen", "tag")))


def canonical_names(renames: list[tuple[str, str, int]]) -> dict[str, str]:
    """old name -> the name it finally goes by, following the most frequent rename of each name; cycles end at their least name."""
    step = {old: new for old, new, _ in sorted(renames, key=lambda r: (r[2], r[1]))}
    out = {}
    for name in step:
        path = [name]
        while (then := step.get(path[-1])) is not None and then not in path:
            path.append(then)
        end = min(path[path.index(then) :]) if then is not None else path[-1]
        if end != name:
            out[name] = end
    return out


def lasting_renames(changes: DataFrame, kind: str, max_fields: int) -> dict[str, str]:
    """Names of ``kind`` that were given up for another more often than they were dropped, with the name to use instead."""
    mine = changes.where(F.col("doc_kind") == kind)
    given_up = mine.where("change = 'renamed'").groupBy(F.col("old_field").alias("old"), F.col("field").alias("new")).agg(F.count("*").alias("n"))
    dropped = mine.where("change = 'removed'").groupBy(F.col("field").alias("old")).agg(F.count("*").alias("d"))
    rows = given_up.join(dropped, "old", "left").where("n > coalesce(d, 0)").limit(max_fields + 1).collect()
    if len(rows) > max_fields:
        raise ValueError(f"more than {max_fields} renames of {kind}")
    return canonical_names([(r["old"], r["new"], r["n"]) for r in rows])


def number_type(row) -> str | None:
    """The narrowest column type that holds all numbers of a field exactly; None if only text does."""
    if not row["fractions"]:
        return "bigint" if row["digits"] <= 18 else f"decimal({max(row['digits'], 19)},0)" if row["digits"] <= 38 else None
    return None if row["inexact"] or row["digits"] > 15 else "double"


def consistent_table(files: DataFrame, kind: str, max_fields: int = 5_000) -> DataFrame:
    """One row per readable file of ``kind``, one column per field, plus typed branches where a field had several types.

    A field with one type gets a column of that type: whole numbers bigint, or a decimal beyond 18 digits; other numbers double,
    or text where a double would change one of them; objects and arrays as JSON text. A field with several types gets ``<field>``
    as canonical text and ``<field>__<type>`` per alternative. Dots in names become underscores; names that then collide get a
    numbered suffix. A field that was renamed lastingly shares the column of its final name, but where a file holds both, each
    keeps its own. The list of fields and types is read once by the driver; more than ``max_fields`` alternatives raise an error
    instead of being dropped.
    """
    union = tagged_union(files.where(F.col("doc_kind") == kind))
    values = field_values(union)
    names = lasting_renames(changes_of(union), kind, max_fields)
    if names:
        final = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        has = lambda name: F.array_contains(F.col("fields"), name)
        rows = union.select("file_id", *STREAM, "written_at", "fields", F.explode(F.arrays_zip("fields", "tags", "vals")).alias("f"))
        to = final[F.col("f.fields")]
        # Of several old names of one field in a file without the final one, the first takes its column.
        rivals = F.exists(F.col("fields"), lambda x: (final[x] == to) & (x < F.col("f.fields")))
        name = F.when(to.isNull() | has(to) | rivals, F.col("f.fields")).otherwise(to)
        values = rows.select("file_id", *STREAM, "written_at", name.alias("field"), F.col("f.tags").alias("tag"), F.when(F.col("f.tags").isNotNull(), F.col("f.vals")).alias("value"))
    number = F.when(F.col("tag") == "number", F.col("value"))
    whole = number.rlike(r"^-?\d+$")
    exact = F.coalesce(F.lower(number.try_cast("double").cast("string")) == F.lower(number), F.lit(False)) | (number.try_cast("decimal(38,18)") == number.try_cast("double").cast("string").try_cast("decimal(38,18)"))
    kinds = values.groupBy("field").agg(
        F.array_sort(F.collect_set("tag")).alias("tags"),
        F.coalesce(F.max(F.when(whole, F.length(F.ltrim(number, F.lit("-"))))), F.lit(0)).alias("digits"),
        F.count_if(number.isNotNull() & ~whole).alias("fractions"),
        F.count_if(number.isNotNull() & ~whole & ~F.coalesce(exact, F.lit(False))).alias("inexact"),
    )
    kinds = kinds.orderBy("field").limit(max_fields + 1).collect()
    if len(kinds) > max_fields:
        raise ValueError(f"more than {max_fields} fields of {kind}")
    packed = values.groupBy("file_id", *STREAM, "written_at").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("v"), F.map_from_entries(F.collect_list(F.struct("field", "tag"))).alias("t")
    )
    taken = {"file_id", "doc_kind", "stream_key", "written_at"}
    columns: list[Column] = []

    def name(base: str) -> str:
        n, i = base.replace(".", "_"), 1
        while n.lower() in taken:
            i += 1
            n = f"{base.replace('.', '_')}_{i}"
        taken.add(n.lower())
        return n

    def typed(row, t: str) -> Column:
        v = F.col("v")[F.lit(row["field"])]
        if t == "number" and (narrow := number_type(row)):
            v = v.try_cast(narrow)
        elif t == "boolean":
            v = v.try_cast("boolean")
        return F.when(F.col("t")[F.lit(row["field"])] == t, v)

    for row in kinds:
        tags = list(row["tags"])
        columns.append((typed(row, tags[0]) if len(tags) == 1 else F.col("v")[F.lit(row["field"])]).alias(name(row["field"])))
        if len(tags) > 1:
            columns += [typed(row, t).alias(name(f"{row['field']}__{t}")) for t in tags]
    return packed.select("file_id", "stream_key", "written_at", *columns)
