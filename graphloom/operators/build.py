"""From reflection documents to the graph: raw nodes, edges and warnings, section by section.

The documents' containers come in several spellings, so a first pass (Python, batch-wise) writes each section's entries as rows
of regular JSON. Everything after that is expressions over one parsed struct: each entry yields its nodes and edges as arrays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import nested
from graphloom.operators.graph import unique_nodes
from graphloom.session import materialize

ITEMS = "project_slug string, section string, ord int, payload string"
#: Sections in the order in which their nodes and edges come.
SECTIONS = ["class", "route", "event", "wildcard", "gate", "policy", "alias", "binding", "schedule", "finding"]

PAYLOAD = """
source string, kinds array<string>, name string, short_name string, namespace string, file string, is_abstract boolean, final boolean, readonly boolean,
parent string, interfaces array<string>, interfaces_inherited array<string>, traits array<string>,
methods array<struct<name: string, visibility: string, static: boolean, abstract: boolean, final: boolean, return_type: string, line: int,
  parameters: array<struct<name: string, type: string, optional: boolean, variadic: boolean>>>>,
cases array<struct<name: string, value: string>>, uri string, verbs array<string>, domain string, wheres map<string, string>, route_parameters array<string>, middleware array<string>,
action struct<kind: string, controller: string, method: string>, event string,
listeners array<struct<place: int, kind: string, class: string, method: string, file: string, line: int, queued: boolean, source: string>>,
ability string, model string, policy string, alias string, class string, method string, abstract string, shared boolean,
concrete struct<kind: string, class: string, file: string, line: int>, expression string, timezone string, description string, command string, target string,
without_overlapping boolean, on_one_server boolean, kind string, in_class string, in_method string, line int,
meta struct<model: string, form: string, method: string, channel_kind: string, abstract: string, binding_kind: string>
"""

#: Class labels in order of precedence, and the kind each stands for.
KIND_PRIORITY = [(k, k) for k in "interface enum trait bootstrap controller form_request policy middleware observer listener job notification mailable event model resource".split()] + [
    ("resource_collection", "resource"), ("command", "command"), ("service_provider", "service_provider"), ("cast", "cast"),
]
#: Findings that become an edge of one kind to a class.
EFFECTS = {"event_dispatch": "fires", "job_dispatch": "dispatches", "notification_dispatch": "notifies"}
HANDLER_METHODS = ["handle", "__invoke"]
MESSAGE_SUFFIXES = ["Command", "Query"]


@dataclass(frozen=True)
class Built:
    """nodes(project_slug, id, kind, name, attributes), edges(edge_seq, project_slug, source, target, kind, attributes), warnings(project_slug, code, context)."""

    nodes: DataFrame
    edges: DataFrame
    warnings: DataFrame


# --- the regular form -------------------------------------------------------------------------------------------------


def _listener(value):
    if isinstance(value, str):
        name, _, method = value.partition("@")
        return {"kind": "class", "class": name, "method": method or None}
    return value if isinstance(value, dict) else {"kind": "closure"}


def _maps(value) -> dict:
    value = nested.unwrap(value)
    return value if isinstance(value, dict) else {}


def _names(value) -> list[str]:
    """The texts of a list, or the names of its objects."""
    value = nested.unwrap(value)
    found = [x.get("name") if isinstance(x, dict) else x for x in value] if isinstance(value, list) else []
    return [x for x in found if isinstance(x, str)]


def regular_items(body) -> Iterator[tuple[str, int, dict]]:
    """(section, place, entry) of every entry of one document, in one spelling."""
    get, places = nested._get, nested.places
    s = get(body, "sections")
    for pos, key, entry in places(get(get(s, "classes"), "items"), "class"):
        r = get(entry, "reflection")
        if isinstance(r, dict) and r.get("name"):
            cases = [c if isinstance(c, dict) else {"name": c} for _, _, c in places(r.get("cases"), "case")]
            yield "class", pos, r | {"is_abstract": r.get("abstract"), "abstract": None, "source": _maps(entry).get("source"), "kinds": _maps(entry).get("kinds"), "cases": cases}
    routes = get(s, "routes")
    routes = get(routes, "items") if isinstance(routes, dict) and "items" in routes else routes
    for pos, r in enumerate(routes if isinstance(routes, list) else []):
        if isinstance(r, dict):
            yield "route", pos, r | {"verbs": r.get("methods"), "methods": None, "action": _maps(r.get("action")), "wheres": _maps(r.get("wheres")), "route_parameters": _names(r.get("parameters"))}
    for section, kind in (("listeners", "event"), ("wildcards", "wildcard")):
        for pos, key, entry in places(get(get(s, "events"), section), "event"):
            named = isinstance(entry, dict) and nested.ALONE["event"] & entry.keys()
            name, held = (entry.get("event", key), entry.get("listeners")) if named else (key, entry)
            if isinstance(name, str):
                yield kind, pos, {"event": name, "listeners": [_listener(x) | {"place": p} for p, _, x in places(held, "listener")]}
    gates = get(s, "gates_policies")
    for pos, g in enumerate(get(gates, "gates") or []):
        if isinstance(g, dict):
            yield "gate", pos, {"ability": g.get("ability")} | {k: _maps(g.get("callback")).get(k) for k in ("kind", "class", "method")}
    for pos, p in enumerate(get(gates, "policies") or []):
        if isinstance(p, dict):
            yield "policy", pos, {"model": p.get("model"), "policy": p.get("policy")}
    for pos, (alias, name) in enumerate(_maps(get(get(s, "middleware"), "aliases")).items()):
        yield "alias", pos, {"alias": alias, "class": name}
    for pos, key, b in places(get(get(s, "bindings"), "bindings"), "binding"):
        b = b if isinstance(b, dict) and nested.ALONE["binding"] & b.keys() else {"abstract": key, "concrete": b}
        concrete = nested.unwrap(b.get("concrete"))
        yield "binding", pos, {"abstract": b.get("abstract") or key, "shared": b.get("shared"), "concrete": {"kind": "class", "class": concrete} if isinstance(concrete, str) else _maps(concrete)}
    schedule = get(s, "schedule")
    schedule = (get(schedule, "events") or get(schedule, "items")) if isinstance(schedule, dict) else schedule
    for pos, t in enumerate(schedule if isinstance(schedule, list) else []):
        if isinstance(t, dict):
            yield "schedule", pos, t
    for pos, f in enumerate(get(get(s, "static_analysis"), "findings") or []):
        if isinstance(f, dict):
            yield "finding", pos, f | {"meta": _maps(f.get("meta"))}


#: Levels of an entry that are kept; PAYLOAD names none below the seventh, and the JSON reader of the JVM ends at the thousandth.
LEVELS = 12


def shallower(value, levels: int = LEVELS):
    """A value without the containers that lie deeper than ``levels``."""
    if isinstance(value, dict):
        return {k: shallower(v, levels - 1) for k, v in value.items()} if levels else None
    if isinstance(value, list):
        return [shallower(v, levels - 1) for v in value] if levels else None
    return value


def _stated_version(bodies: pd.Series) -> pd.Series:
    """The schema_version a body states, empty if none; null for a body that cannot be read. Depth does not matter."""
    out: list[str | None] = []
    for text in bodies:
        try:
            body = nested.unwrap(nested.read_json(text))
            version = body.get("schema_version") if isinstance(body, dict) else None
            out.append("" if version is None or isinstance(version, (dict, list)) else str(version))
        except nested.Unreadable:
            out.append(None)
    return pd.Series(out, dtype=object)


def _itemise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for slug, text in zip(batch["project_slug"], batch["body"]):
            try:
                out += [(slug, section, pos, nested.canonical(shallower(entry))) for section, pos, entry in regular_items(nested.unwrap(nested.read_json(text)))]
            except nested.Unreadable:
                continue
        yield pd.DataFrame(out, columns=["project_slug", "section", "ord", "payload"])


def current_documents(docs: DataFrame) -> DataFrame:
    """The latest readable document of each project (schema major version 2 where one is given); it replaces all earlier ones."""
    rows = docs.where("project_slug IS NOT NULL").select("project_slug", "document_id", "received_at", "body", F.pandas_udf(_stated_version, "string")("body").alias("version"))
    rows = rows.where((F.col("version") == "") | F.col("version").startswith("2."))
    w = Window.partitionBy("project_slug").orderBy(F.col("received_at").desc_nulls_last(), F.col("document_id").desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("project_slug", "body")


def section_items(docs: DataFrame) -> DataFrame:
    """(project_slug, section, ord, p): every entry of the current documents, parsed."""
    items = materialize(current_documents(docs).mapInPandas(_itemise, ITEMS))
    return items.select("project_slug", "section", "ord", F.from_json("payload", PAYLOAD).alias("p"))


# --- nodes and edges --------------------------------------------------------------------------------------------------


def _node(node_id: Column, kind, name: Column, /, **attributes: Column) -> Column:
    attrs = F.to_json(F.struct(*[v.alias(k) for k, v in attributes.items()])) if attributes else F.lit("{}")
    return F.struct(node_id.alias("id"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), name.alias("name"), attrs.alias("attributes"))


def _edge(source: Column, target: Column, kind, /, **attributes: Column) -> Column:
    attrs = F.to_json(F.struct(*[v.alias(k) for k, v in attributes.items()])) if attributes else F.lit("{}")
    return F.struct(source.alias("source"), target.alias("target"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), attrs.alias("attributes"))


def _id(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix), *parts)


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.from_json(F.lit("[]"), {"p.methods": "array<struct<name: string, visibility: string, static: boolean, abstract: boolean, final: boolean, return_type: string, line: int, parameters: array<struct<name: string, type: string, optional: boolean, variadic: boolean>>>>", "p.listeners": "array<struct<place: int, kind: string, class: string, method: string, file: string, line: int, queued: boolean, source: string>>"}.get(name, "array<string>")))


def class_kind(kinds: Column) -> Column:
    """The first label of the precedence list a class carries; ``class`` if it carries none."""
    ladder = None
    for label, kind in KIND_PRIORITY:
        hit = F.array_contains(kinds, label)
        ladder = F.when(hit, kind) if ladder is None else ladder.when(hit, kind)
    return F.coalesce(ladder, F.lit("class"))


def inherited_kinds(classes: DataFrame, custom_bases: dict[str, str], max_depth: int = 20) -> DataFrame:
    """(project_slug, fqn, inherited): the kind of the nearest ancestor that is a configured base; the walk ends at unknown parents and cycles."""
    spark = classes.sparkSession
    known = dict(KIND_PRIORITY)
    bases = spark.createDataFrame([(b, known.get(label, "class")) for b, label in custom_bases.items()] or [], "ancestor string, inherited string")
    step = classes.select("project_slug", F.col("p.name").alias("fqn"), F.col("p.parent").alias("ancestor")).where("ancestor IS NOT NULL").dropDuplicates(["project_slug", "fqn"])
    step = materialize(step)
    chain, found = step, None
    for depth in range(max_depth):
        hit = chain.join(F.broadcast(bases), "ancestor").select("project_slug", "fqn", "inherited", F.lit(depth).alias("depth"))
        found = hit if found is None else found.unionByName(hit)
        up = step.select("project_slug", F.col("fqn").alias("ancestor"), F.col("ancestor").alias("next"))
        chain = materialize(chain.join(F.broadcast(bases), "ancestor", "left_anti").join(up, ["project_slug", "ancestor"]).where("next <> fqn").select("project_slug", "fqn", F.col("next").alias("ancestor")))
        if not chain.limit(1).count():
            break
    return found.groupBy("project_slug", "fqn").agg(F.min_by("inherited", "depth").alias("inherited"))


def build_graph(docs: DataFrame, custom_bases: dict[str, str] | None = None) -> Built:
    """The whole build. Nodes are first-wins by id in section order; edges keep that order in ``edge_seq`` and are not deduplicated."""
    items = section_items(docs)
    kind = class_kind(F.coalesce(F.col("p.kinds"), F.array().cast("array<string>")))
    if custom_bases:
        classes = items.where("section = 'class'")
        items = items.withColumn("fqn", F.col("p.name")).join(inherited_kinds(classes, custom_bases), ["project_slug", "fqn"], "left")
        kind = F.when(kind == "class", F.coalesce("inherited", F.lit("class"))).otherwise(kind)
    items = items.withColumns({"kind": F.when(F.col("section") == "class", kind), "base": F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")) * (1 << 40) + F.col("ord").cast("long") * (1 << 16)})

    cls = _id("class:", F.col("p.name"))
    method = lambda m: _id("method:", F.col("p.name"), F.lit("::"), m["name"])
    route = _id("route:", F.coalesce(F.try_element_at(F.col("p.verbs"), F.lit(1)), F.lit("ANY")), F.lit(":"), F.col("p.uri"))
    event = _id("event:", F.col("p.event"))
    by_class = F.filter(_list("p.listeners"), lambda x: (x["kind"] == "class") & x["class"].isNotNull())
    listener = lambda x: _id("listener:", x["class"], F.lit("::"), F.coalesce(x["method"], F.lit("handle")))
    task_target = F.coalesce(F.nullif(F.col("p.command"), F.lit("")), F.nullif(F.col("p.target"), F.lit("")), F.lit("<closure>"))
    task = _id("schedule:", F.coalesce("p.expression", F.lit("")), F.lit("|"), task_target)
    binding = _id("binding:", F.col("p.abstract"))
    site = F.when(F.coalesce("p.in_method", F.lit("")) != "", _id("method:", F.col("p.in_class"), F.lit("::"), F.col("p.in_method"))).otherwise(_id("class:", F.col("p.in_class")))
    usable = (F.coalesce("p.in_class", F.lit("")) != "") & (F.coalesce("p.target", F.lit("")) != "")
    finding, target = F.col("p.kind"), F.col("p.target")
    channel = F.coalesce("p.meta.channel_kind", F.lit("Channel"))
    at = {"file": F.col("p.file"), "line": F.col("p.line")}
    p = lambda *names: {n: F.col(f"p.{n}") for n in names}
    is_ = lambda s: F.col("section") == s

    class_nodes = F.concat(
        F.array(_node(cls, F.col("kind"), F.coalesce("p.short_name", F.substring_index("p.name", "\\", -1)), fqn=F.col("p.name"), abstract=F.col("p.is_abstract"), **p("namespace", "file", "final", "readonly", "source", "kinds", "cases", "interfaces_inherited"))),
        F.transform(_list("p.methods"), lambda m: _node(method(m), "method", m["name"], class_fqn=F.col("p.name"), **{k: m[k] for k in ("visibility", "static", "abstract", "final", "return_type", "line", "parameters")})),
    )
    event_nodes = F.concat(
        F.array(_node(event, "event", F.col("p.event"), wildcard=is_("wildcard"))),
        F.transform(by_class, lambda x: _node(listener(x), "listener", x["class"], class_fqn=x["class"], method=F.coalesce(x["method"], F.lit("handle")), queued=F.coalesce(x["queued"], F.lit(False)), file=x["file"])),
    )
    finding_nodes = F.array(
        _node(
            F.when(finding == "view_return", _id("view:", target)).when(finding.isin("cache_read", "cache_write"), _id("cache_key:", target)).otherwise(_id("broadcast_channel:", channel, F.lit(":"), target)),
            F.when(finding == "view_return", "view").when(finding.isin("cache_read", "cache_write"), "cache_key").otherwise("broadcast_channel"),
            target, channel_kind=F.when(finding == "broadcast_channel", channel),
        )
    )
    nodes = (
        F.when(is_("class"), class_nodes)
        .when(is_("route") & F.col("p.uri").isNotNull(), F.array(_node(route, "route", F.col("p.uri"), methods=F.col("p.verbs"), action_kind=F.col("p.action.kind"), wheres=F.col("p.wheres"), parameters=F.col("p.route_parameters"), **p("uri", "name", "domain"))))
        .when(is_("event") | is_("wildcard"), event_nodes)
        .when(is_("gate") & F.col("p.ability").isNotNull(), F.array(_node(_id("gate:", F.col("p.ability")), "gate", F.col("p.ability"), callback_kind=F.col("p.kind"), callback_class=F.col("p.class"), callback_method=F.col("p.method"))))
        .when(is_("policy") & F.col("p.policy").isNotNull(), F.array(_node(_id("policy:", F.col("p.policy")), "policy", F.col("p.policy"), **p("model", "policy"))))
        .when(is_("alias"), F.array(_node(_id("middleware:", F.col("p.alias")), "middleware", F.col("p.alias"), alias=F.col("p.alias"), class_fqn=F.col("p.class"))))
        .when(is_("schedule"), F.array(_node(task, "scheduled_task", F.coalesce(F.nullif(F.col("p.description"), F.lit("")), task_target), callback_target=F.col("p.target"), **p("expression", "timezone", "command", "without_overlapping", "on_one_server", "kind"))))
        .when(is_("finding") & usable & finding.isin("view_return", "cache_read", "cache_write", "broadcast_channel"), finding_nodes)
    )
    flat = items.select("project_slug", "base", F.posexplode(nodes).alias("sub", "n")).select("project_slug", (F.col("base") + F.col("sub")).alias("seq"), "n.*").where("id IS NOT NULL")

    # Bindings: of the static entries and the closures whose concrete class the source reveals, one node per abstract.
    stated = items.where("section = 'binding' AND p.abstract IS NOT NULL").select("project_slug", F.col("p.abstract").alias("abstract"), F.struct("base", "p.shared", "p.concrete").alias("s"))
    revealed = items.where("section = 'finding' AND p.kind = 'closure_binding' AND p.target <> '' AND p.meta.abstract <> ''").select("project_slug", F.col("p.meta.abstract").alias("abstract"), F.struct("base", "p.target", "p.file", "p.line", "p.meta.binding_kind").alias("f"))
    bound = stated.groupBy("project_slug", "abstract").agg(F.min_by("s", "s.base").alias("s")).join(revealed.groupBy("project_slug", "abstract").agg(F.min_by("f", "f.base").alias("f")), ["project_slug", "abstract"], "full")
    use_found = F.col("f").isNotNull() & (F.col("s").isNull() | (F.coalesce("s.concrete.kind", F.lit("")) != "class"))
    bound_nodes = bound.select(
        "project_slug", F.coalesce("s.base", "f.base").alias("seq"),
        _node(
            _id("binding:", F.col("abstract")), "binding", F.col("abstract"), shared=F.coalesce("s.shared", F.col("f.binding_kind").isin("singleton", "scoped", "instance")), concrete_kind=F.when(use_found, "class").otherwise(F.col("s.concrete.kind")),
            concrete_class=F.when(use_found, F.col("f.target")).otherwise(F.col("s.concrete.class")), concrete_file=F.when(use_found, F.col("f.file")).otherwise(F.col("s.concrete.file")),
            concrete_line=F.when(use_found, F.col("f.line")).otherwise(F.col("s.concrete.line")), source=F.when(use_found, "static"),
        ).alias("n"),
    ).select("project_slug", "seq", "n.*")
    all_nodes = unique_nodes(flat.unionByName(bound_nodes), "seq")

    inherits = F.concat(
        F.when(F.col("p.parent").isNotNull(), F.array(_edge(cls, _id("class:", F.col("p.parent")), "extends"))).otherwise(F.array().cast("array<struct<source:string,target:string,kind:string,attributes:string>>")),
        F.transform(_list("p.interfaces"), lambda x: _edge(cls, _id("class:", x), "implements")),
        F.transform(_list("p.traits"), lambda x: _edge(cls, _id("class:", x), "uses_trait")),
        F.transform(_list("p.methods"), lambda m: _edge(method(m), cls, "part_of")),
        F.flatten(F.transform(_list("p.methods"), lambda m: F.transform(F.filter(F.coalesce(m["parameters"], F.array().cast("array<struct<name:string,type:string,optional:boolean,variadic:boolean>>")), lambda q: q["type"].isNotNull()), lambda q: _edge(method(m), _id("class:", F.regexp_replace(q["type"], r"^[?\\]+", "")), "validates_with")))),
    )
    routed = F.concat(
        F.when((F.col("p.action.kind") == "controller") & F.col("p.action.controller").isNotNull() & F.col("p.action.method").isNotNull(), F.array(_edge(route, _id("method:", F.col("p.action.controller"), F.lit("::"), F.col("p.action.method")), "routes_to"))).otherwise(F.array().cast("array<struct<source:string,target:string,kind:string,attributes:string>>")),
        F.transform(_list("p.middleware"), lambda x: _edge(route, _id("middleware:", x), "has_middleware")),
    )
    effect = F.create_map(*[F.lit(x) for pair in EFFECTS.items() for x in pair])[finding]
    finding_edge = (
        F.when(effect.isNotNull() & usable, _edge(site, _id("class:", target), effect, form=F.col("p.meta.form"), method=F.col("p.meta.method"), **at))
        .when((finding == "view_return") & usable, _edge(site, _id("view:", target), "returns_view", form=F.lit(None).cast("string"), method=F.lit(None).cast("string"), **at))
        .when(finding.isin("cache_read", "cache_write") & usable, _edge(site, _id("cache_key:", target), finding, form=F.col("p.meta.form"), method=F.col("p.meta.method"), **at))
        .when((finding == "broadcast_channel") & usable, _edge(_id("class:", F.col("p.in_class")), _id("broadcast_channel:", channel, F.lit(":"), target), "broadcasts_to", channel_kind=channel, form=F.col("p.meta.form"), **at))
        .when(finding.isin("authorize", "gate_check") & usable, _edge(site, _id("gate:", target), "authorised_by", **at))
        .when((finding == "observer_registration") & (F.col("p.meta.model") != "") & target.isNotNull(), _edge(_id("class:", target), _id("class:", F.col("p.meta.model")), "observes", **at))
        .when((finding == "closure_binding") & (target != "") & (F.col("p.meta.abstract") != ""), _edge(_id("binding:", F.col("p.meta.abstract")), _id("class:", target), "bound_to", source=F.lit("static"), **at))
    )
    edges = (
        F.when(is_("class"), inherits).when(is_("route"), routed)
        .when(is_("event") | is_("wildcard"), F.transform(by_class, lambda x: _edge(listener(x), event, "listens_to", order=x["place"], source=x["source"])))
        .when(is_("policy"), F.array(_edge(_id("policy:", F.col("p.policy")), _id("class:", F.col("p.model")), "applies_to")))
        .when(is_("binding") & (F.col("p.concrete.kind") == "class") & F.col("p.concrete.class").isNotNull(), F.array(_edge(binding, _id("class:", F.col("p.concrete.class")), "bound_to")))
        .when(is_("schedule") & (F.col("p.target") != ""), F.array(_edge(task, _id("class:", target), "runs_command", expression=F.col("p.expression"))))
        .when(is_("finding") & finding_edge.isNotNull(), F.array(finding_edge))
    )
    raw = items.select("project_slug", "base", F.posexplode(edges).alias("sub", "x")).select("project_slug", (F.col("base") + F.col("sub")).alias("seq"), "x.*").where("source IS NOT NULL AND target IS NOT NULL")
    forms = all_nodes.where("kind = 'form_request'").select("project_slug", F.col("id").alias("target"))
    raw = raw.where("kind <> 'validates_with' AND kind <> 'bound_to'").unionByName(raw.where("kind = 'validates_with'").join(forms, ["project_slug", "target"], "left_semi")).unionByName(
        raw.where("kind = 'bound_to'").groupBy("project_slug", "source", "target", "kind").agg(F.min(F.struct("seq", "attributes")).alias("r")).select("project_slug", "r.seq", "source", "target", "kind", "r.attributes")
    )
    calls, ambiguous = bus_calls(items, all_nodes)
    raw = raw.unionByName(calls)
    numbered = raw.withColumn("edge_seq", F.row_number().over(Window.partitionBy("project_slug").orderBy("seq", "source", "target", "kind")).cast("long"))
    closures = items.where(is_("event") | is_("wildcard")).select("project_slug", F.lit("closure_listener").alias("code"), F.col("p.event").alias("context"), F.explode(F.filter(_list("p.listeners"), lambda x: (F.coalesce(x["kind"], F.lit("")) != "class") | x["class"].isNull()))).drop("col")
    incomplete = items.where(is_("route") & (F.col("p.action.kind") == "controller") & (F.col("p.action.controller").isNull() | F.col("p.action.method").isNull())).select("project_slug", F.lit("route_action_incomplete").alias("code"), route.alias("context"))
    return Built(all_nodes, numbered.select("edge_seq", "project_slug", "source", "target", "kind", "attributes"), closures.unionByName(incomplete).unionByName(ambiguous))


def bus_calls(items: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls from a message's dispatch to its handler by naming convention, and warnings where several classes carry the handler's name."""
    sent = items.where("section = 'finding' AND p.kind = 'bus_dispatch' AND p.target <> '' AND p.in_class <> '' AND p.in_method <> ''")
    short = F.substring_index("p.target", "\\", -1)
    names = F.array(F.concat(short, F.lit("Handler")), *[F.when(short.endswith(s) & (F.length(short) > len(s)), F.concat(F.substr(short, F.lit(1), F.length(short) - len(s)), F.lit("Handler"))) for s in MESSAGE_SUFFIXES])
    sent = sent.select("project_slug", F.col("base").alias("seq"), "p", F.posexplode(names).alias("try", "handler")).where("handler IS NOT NULL")
    classes = nodes.where(F.col("id").startswith("class:")).select("project_slug", F.substr("id", F.lit(7)).alias("fqn")).withColumn("handler", F.substring_index("fqn", "\\", -1))
    classes = classes.groupBy("project_slug", "handler").agg(F.count("*").alias("n"), F.min("fqn").alias("fqn"))
    best = sent.join(classes, ["project_slug", "handler"]).groupBy("project_slug", "seq").agg(F.min_by(F.struct("p", "handler", "n", "fqn"), "try").alias("b"))
    methods = nodes.where("kind = 'method'").select("project_slug", F.col("id").alias("target"))
    tried = best.where("b.n = 1").select("project_slug", "seq", "b.p", F.posexplode(F.array(*[_id("method:", F.col("b.fqn"), F.lit(f"::{m}")) for m in HANDLER_METHODS])).alias("try", "target")).join(methods, ["project_slug", "target"], "left_semi")
    first = tried.groupBy("project_slug", "seq").agg(F.min_by(F.struct("p", "target"), "try").alias("r"))
    edge = _edge(_id("method:", F.col("r.p.in_class"), F.lit("::"), F.col("r.p.in_method")), F.col("r.target"), "calls", via=F.lit("bus_convention"), synthetic=F.lit(True), message=F.col("r.p.target"), file=F.col("r.p.file"), line=F.col("r.p.line"))
    warnings = best.where("b.n > 1").select("project_slug", F.lit("bus_handler_ambiguous").alias("code"), F.col("b.p.target").alias("context"))
    return first.select("project_slug", "seq", edge.alias("x")).select("project_slug", "seq", "x.*"), warnings


# --- references, carry-forward, paths ---------------------------------------------------------------------------------


def enclosing_calls(references: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls from references (project_slug, target, file, line, character): the enclosing method is that of the file with the greatest start line not after it.

    ``methods``: (project_slug, method_id, file, start_line). An as-of join: both sides are ordered together within each file and
    the last method start is carried forward. References before any method, and of a method to itself, give nothing.
    """
    starts = methods.where("file IS NOT NULL AND start_line IS NOT NULL").select("project_slug", "file", F.col("start_line").alias("line"), F.lit(0).alias("is_ref"), F.col("method_id").alias("start"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("character"))
    refs = references.select("project_slug", "file", "line", F.lit(1).alias("is_ref"), F.lit(None).cast("string").alias("start"), "target", "character")
    w = Window.partitionBy("project_slug", "file").orderBy("line", "is_ref", "start").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(refs).withColumn("source", F.last("start", ignorenulls=True).over(w))
    return found.where("is_ref = 1 AND source IS NOT NULL AND source <> target").select("project_slug", "source", "target", "file", "line", "character").distinct()


def method_starts(nodes: DataFrame) -> DataFrame:
    """(project_slug, method_id, file, start_line) from raw nodes; the file is that of the method's class."""
    a = lambda k: F.get_json_object("attributes", f"$.{k}")
    methods = nodes.where("kind = 'method'").select("project_slug", F.col("id").alias("method_id"), F.concat(F.lit("class:"), a("class_fqn")).alias("class_id"), a("line").try_cast("int").alias("start_line"))
    files = nodes.where(F.col("id").startswith("class:")).select("project_slug", F.col("id").alias("class_id"), a("file").alias("file"))
    return methods.join(files, ["project_slug", "class_id"]).select("project_slug", "method_id", "file", "start_line")


def carry_forward(old_calls: DataFrame, new_calls: DataFrame, nodes: DataFrame, changed: DataFrame, full_above: float = 0.5) -> DataFrame:
    """Calls after an incremental run: kept from before where the target's file is unchanged and the source still exists, else recomputed.

    ``changed``: (project_slug, file). A project with more than ``full_above`` of its files changed keeps nothing.
    """
    starts = method_starts(nodes)
    files = starts.select("project_slug", "file").distinct()
    hit = files.join(changed.select("project_slug", "file").distinct().withColumn("c", F.lit(1)), ["project_slug", "file"], "left")
    keep = hit.groupBy("project_slug").agg(F.avg(F.coalesce("c", F.lit(0))).alias("share")).where(F.col("share") <= full_above).select("project_slug")
    steady = starts.join(hit.where("c IS NULL").select("project_slug", "file"), ["project_slug", "file"], "left_semi").select("project_slug", F.col("method_id").alias("target"))
    kept = old_calls.join(keep, "project_slug", "left_semi").join(steady, ["project_slug", "target"], "left_semi")
    kept = kept.join(nodes.select("project_slug", F.col("id").alias("source")), ["project_slug", "source"], "left_semi")
    return kept.unionByName(new_calls).dropDuplicates(["project_slug", "source", "target", "file", "line"])


def symbol_column(line_text: Column, name: Column) -> Column:
    """1-based column of a name's first occurrence on its line; null if it is not there."""
    return F.nullif(F.instr(line_text, name), F.lit(0))


def normalise_path(path: Column, vendor_prefix: str) -> Column:
    """A path relative to the package, if it lies below the prefix."""
    prefix = vendor_prefix.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
