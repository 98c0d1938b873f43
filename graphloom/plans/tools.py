"""The named structural queries over the graph, each answering for every subject; parameters narrow it down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.glob import matches_glob, matches_uri_glob
from graphloom.operators import graph as G
from graphloom.operators.graph import Graph, joined

MODULE_SEGMENTS = ("Modules", "Module")

#: Words that carry no meaning in a fuzzy route question, and return types that mark a relation.
STOP_WORDS = (
    "a an and are as at be by do does for from in into is it of on or that the their this to was were when where which who with"
).split()
RELATIONS = ["HasMany", "BelongsTo", "BelongsToMany", "HasOne", "MorphTo", "MorphMany", "MorphOne", "MorphToMany"]
#: Kinds a search by name covers.
SEARCHABLE_KINDS = [
    "controller", "model", "event", "listener", "job", "notification", "mailable", "policy", "form_request", "observer",
    "resource", "command", "service_provider", "cast", "class",
]


def _verbs(a: str = "a") -> Column:
    return F.array_join(F.coalesce(F.col(f"{a}.methods"), F.array().cast("array<string>")), ",")


def _uri(name: Column, a: str = "a") -> Column:
    return F.coalesce(F.nullif(F.col(f"{a}.uri"), F.lit("")), name)


def _handlers(g: Graph) -> DataFrame:
    """(project_slug, route_id, method_id, handler, handler_method, ...): each route's first handler that is a node."""
    found = G.with_targets(g, g.edges_of("routes_to"))
    found = found.select("project_slug", F.col("source").alias("route_id"), "edge_seq", F.col("target").alias("method_id"), F.col("target_a.class_fqn").alias("handler"), F.col("target_name").alias("handler_method"), F.col("target_a.line").alias("handler_line"))
    return G.first_edge(found, ["project_slug", "route_id"], "method_id", "handler", "handler_method", "handler_line")


def list_routes(g: Graph, method: str | None = None, uri_glob: str | None = None, name_glob: str | None = None, middleware: str | None = None) -> DataFrame:
    """Routes with handler and sorted middleware; filters combine, the verb's case does not count, a null name never matches."""
    routes = g.of_kind("route").select("project_slug", F.col("id").alias("route_id"), _uri(F.col("name")).alias("uri"), F.col("a.methods").alias("verbs"), _verbs().alias("methods"), F.col("a.name").alias("name"), F.coalesce(F.nullif(F.col("a.action_kind"), F.lit("")), F.lit("unknown")).alias("action_kind"))
    if method:
        routes = routes.where(F.array_contains("verbs", method.upper()))
    if uri_glob:
        routes = routes.where(matches_uri_glob(F.col("uri"), uri_glob))
    if name_glob:
        routes = routes.where(matches_glob(F.col("name"), name_glob))
    to = G.with_targets(g, g.edges_of("routes_to", "has_middleware")).withColumnRenamed("source", "route_id")
    is_mw = F.col("kind") == "has_middleware"
    ends = to.groupBy("project_slug", "route_id").agg(
        F.array_sort(F.collect_list(F.when(is_mw, F.col("target_name")))).alias("mw"),
        F.max_by(F.col("target_a.class_fqn"), F.when(~is_mw & F.col("target_a.class_fqn").isNotNull(), F.col("edge_seq"))).alias("controller"),
        F.max_by("target_name", F.when(~is_mw, F.col("edge_seq"))).alias("method"),
    )
    rows = routes.join(ends, ["project_slug", "route_id"], "left")
    if middleware:
        rows = rows.where(F.array_contains("mw", middleware))
    return rows.select("project_slug", "route_id", "uri", "methods", "name", "controller", "method", "action_kind", F.coalesce(F.array_join("mw", ","), F.lit("")).alias("middleware"))


def list_scheduled_tasks(g: Graph, target_glob: str | None = None, expression_glob: str | None = None) -> DataFrame:
    first = G.first_edge(g.edges_of("runs_command").select("project_slug", F.col("source").alias("id"), "edge_seq", "target"), ["project_slug", "id"], "target")
    rows = g.of_kind("scheduled_task").join(first, ["project_slug", "id"], "left")
    target = F.coalesce(G.class_fqn(F.col("target")), "a.callback_target")
    rows = rows.select(
        "project_slug", "id", F.coalesce("a.expression", F.lit("")).alias("expression"), F.col("a.timezone").alias("timezone"), F.col("name").alias("description"),
        F.coalesce("a.kind", F.lit("callback")).alias("task_kind"), target.alias("target"), F.col("a.command").alias("command"),
        F.coalesce("a.without_overlapping", F.lit(False)).alias("without_overlapping"), F.coalesce("a.on_one_server", F.lit(False)).alias("on_one_server"),
    )
    if expression_glob:
        rows = rows.where(matches_glob(F.col("expression"), expression_glob))
    return rows.where(matches_glob(F.coalesce("target", "command", F.lit("")), target_glob)) if target_glob else rows


def _classes(g: Graph, kinds: list[str]) -> DataFrame:
    nodes = g.of_kind(*kinds).where(F.col("id").startswith("class:"))
    return nodes.select("project_slug", "kind", F.substr("id", F.lit(7)).alias("fqn"), F.col("name").alias("short_name"), F.col("a.file").alias("file"), F.col("a.namespace").alias("namespace"), "a")


def list_by_kind(g: Graph, kind: str | None = None, name_glob: str | None = None, namespace_prefix: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Classes of a kind, or of every kind, by name; the namespace prefix is a plain text prefix. ``position`` counts from 0 per project and kind."""
    if kind is not None and kind not in G.LISTABLE_KINDS:
        raise ValueError(f"non_listable_kind: {kind}")
    rows = _classes(g, [kind] if kind else G.LISTABLE_KINDS).drop("a")
    if name_glob:
        rows = rows.where(matches_glob(F.col("short_name"), name_glob))
    if namespace_prefix:
        rows = rows.where(F.col("fqn").startswith(namespace_prefix))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("project_slug", "kind").orderBy("fqn")) - 1)
    if limit is not None or offset:
        rows = rows.where((F.col("position") >= offset) & (F.col("position") < offset + (limit or (1 << 31))))
    return rows.select("project_slug", "kind", "fqn", "short_name", "file", "namespace", "position")


def module_prefix(fqn: Column) -> Column:
    """Through the segment after ``Modules``/``Module`` unless that is the class itself, else the first two; null for one segment."""
    marked = F.regexp_extract(fqn, r"^((?:[^\\]+\\)*?(?:Modules|Module)\\[^\\]+)\\", 1)
    parts = F.split(fqn, r"\\")
    return F.when(F.size(parts) < 2, None).when(marked != "", marked).otherwise(F.array_join(F.slice(parts, 1, 2), "\\"))


def list_modules(g: Graph, min_classes: int = 2) -> DataFrame:
    counts = _classes(g, G.LISTABLE_KINDS).withColumn("prefix", module_prefix(F.col("fqn"))).where("prefix IS NOT NULL").groupBy("project_slug", "prefix", "kind").agg(F.count("*").alias("n"))
    kinds = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "n"))), ",")
    return counts.groupBy("project_slug", "prefix").agg(F.sum("n").alias("class_count"), kinds.alias("kinds")).where(F.col("class_count") >= min_classes)


def describe_module(g: Graph, prefix: str, sample_per_kind: int = 5) -> DataFrame:
    """Per project and kind strictly below the prefix: total, the first names, the submodules they lie in."""
    inside = prefix.rstrip("\\") + "\\"
    rows = _classes(g, G.LISTABLE_KINDS).where(F.col("fqn").startswith(inside))
    rest = F.substr("fqn", F.lit(len(inside) + 1))
    rows = rows.withColumn("submodule", F.when(F.contains(rest, F.lit("\\")), F.substring_index(rest, "\\", 1)))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("project_slug", "kind").orderBy("fqn")))
    return rows.groupBy("project_slug", "kind").agg(F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= sample_per_kind, F.col("fqn")))), ",").alias("fqns"), joined(F.col("submodule")).alias("submodules"))


def module_routes(g: Graph, prefix: str) -> DataFrame:
    inside = prefix.rstrip("\\") + "\\"
    return g.of_kind("route").withColumnRenamed("id", "route_id").join(_handlers(g).where(F.col("handler").startswith(inside)), ["project_slug", "route_id"]).select("project_slug", _uri(F.col("name")).alias("uri"), _verbs().alias("methods"), F.col("a.name").alias("name"), F.col("handler").alias("handler_fqn"))


def explore_entity(g: Graph, name: str, max_per_kind: int = 10) -> DataFrame:
    """Classes whose name matches: exact_fqn, exact_name, prefix (of the short name), substring (of the full name); best per kind."""
    rows = _classes(g, SEARCHABLE_KINDS)
    low, short = name.lower(), F.lower("short_name")
    rank = F.when(F.col("fqn") == name, 0).when(short == low, 1).when(short.startswith(low), 2).when(F.contains(F.lower("fqn"), F.lit(low)), 3)
    rows = rows.withColumn("rank", rank).where("rank IS NOT NULL")
    rows = rows.withColumns({"position": F.row_number().over(Window.partitionBy("project_slug", "kind").orderBy("rank", "fqn")), "total": F.count("*").over(Window.partitionBy("project_slug", "kind"))})
    quality = F.element_at(F.array(*[F.lit(q) for q in ("exact_fqn", "exact_name", "prefix", "substring")]), F.col("rank") + 1)
    return rows.where(F.col("position") <= max_per_kind).select("project_slug", "kind", "total", "position", "fqn", "short_name", quality.alias("match_quality"))


def describe_class(g: Graph) -> DataFrame:
    """One row per class-like node: header, parent, interfaces, traits, methods, routes, and what its methods cause, as sorted sets.

    A class and the methods that are PART_OF it give one list of (class, node); every edge kind then is one join of that list
    and one aggregation, with the kinds side by side.
    """
    classes = g.of_kind(*G.LISTABLE_KINDS).where(F.col("id").startswith("class:"))
    own = g.edges_of("part_of").select("project_slug", F.col("target").alias("class_id"), F.col("source").alias("member"))
    own = own.join(g.nodes.select("project_slug", F.col("id").alias("member"), F.col("name").alias("member_name")), ["project_slug", "member"])
    effects = G.with_targets(g, g.edges_of("fires", "dispatches", "notifies", "returns_view")).select("project_slug", F.col("source").alias("member"), "kind", "target_name")
    effects = own.join(effects, ["project_slug", "member"]).groupBy("project_slug", "class_id").agg(*[joined(F.when(F.col("kind") == k, F.col("target_name"))).alias(n) for k, n in (("fires", "fires"), ("dispatches", "dispatches"), ("notifies", "notifies"), ("returns_view", "views"))])
    methods = own.groupBy("project_slug", "class_id").agg(joined(F.col("member_name"), distinct=False).alias("methods"))
    routes = G.with_sources(g, g.edges_of("routes_to")).select("project_slug", F.col("target").alias("member"), _uri(F.col("source_name"), "source_a").alias("uri"))
    routes = own.join(routes, ["project_slug", "member"]).groupBy("project_slug", "class_id").agg(joined(F.col("uri")).alias("routes"))
    up = g.edges_of("implements", "uses_trait").join(g.nodes.select("project_slug", F.col("id").alias("target"), F.col("name").alias("target_name")), ["project_slug", "target"], "left")
    up = up.groupBy("project_slug", F.col("source").alias("class_id")).agg(*[joined(F.when(F.col("kind") == k, G.class_fqn(F.col("target"), F.col("target_name")))).alias(n) for k, n in (("implements", "interfaces"), ("uses_trait", "traits"))])
    parent = G.first_edge(g.edges_of("extends").select("project_slug", F.col("source").alias("class_id"), "edge_seq", "target"), ["project_slug", "class_id"], "target")
    parent = parent.join(g.nodes.select("project_slug", F.col("id").alias("target"), F.coalesce(F.nullif(F.col("a.fqn"), F.lit("")), "name").alias("parent")), ["project_slug", "target"]).drop("target")
    policies = G.with_sources(g, g.edges_of("applies_to")).groupBy("project_slug", F.col("target").alias("class_id")).agg(joined(F.col("source_name")).alias("policies"))
    rows = classes.withColumnRenamed("id", "class_id")
    for part in (parent, up, methods, routes, effects, policies):
        rows = rows.join(part, ["project_slug", "class_id"], "left")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("interfaces", "traits", "methods", "routes", "fires", "dispatches", "notifies", "views", "policies")]
    return rows.select(
        "project_slug", "class_id", F.coalesce("a.fqn", F.substr("class_id", F.lit(7))).alias("fqn"), F.col("name").alias("short_name"), F.col("a.namespace").alias("namespace"), F.col("a.file").alias("file"), "kind",
        F.coalesce("a.abstract", F.lit(False)).alias("abstract"), F.coalesce("a.final", F.lit(False)).alias("final"), F.col("a.readonly").alias("readonly"), "parent", *text,
        F.coalesce(F.size(F.filter("a.cases", lambda c: c["name"].isNotNull())), F.lit(0)).alias("case_count"),
        F.array_join(F.transform(F.filter("a.cases", lambda c: c["name"].isNotNull()), lambda c: F.concat_ws("=", c["name"], c["value"])), ",").alias("cases"),
        F.array_join("a.kinds", ",").alias("kinds"), F.array_join(F.array_sort("a.interfaces_inherited"), ",").alias("interfaces_inherited"),
    )


def class_cache_keys(g: Graph) -> DataFrame:
    """(project_slug, class_id, key, mode, form): cache keys the methods of a class use; the form is that of the first use."""
    own = g.edges_of("part_of").select("project_slug", F.col("target").alias("class_id"), F.col("source"))
    used = G.with_targets(g, g.edges_of("cache_read", "cache_write")).join(own, ["project_slug", "source"])
    reads, writes = F.max(F.col("kind") == "cache_read"), F.max(F.col("kind") == "cache_write")
    return used.groupBy("project_slug", "class_id", F.col("target_name").alias("key")).agg(
        F.when(reads & writes, "both").when(writes, "write").otherwise("read").alias("mode"), F.min_by(F.col("e.form"), F.when(F.col("e.form").isNotNull(), F.col("edge_seq"))).alias("form")
    )


def get_model_context(g: Graph) -> DataFrame:
    """One row per method of each model: (project_slug, model, policy, observers, method, category)."""
    models = g.of_kind("model").select("project_slug", F.col("id").alias("model"), F.col("name").alias("short"))
    name, returns = F.col("source_name"), F.coalesce("source_a.return_type", F.lit(""))
    relation = reduce(lambda a, b: a | b, [F.contains(returns, F.lit(r)) for r in RELATIONS])
    category = (
        F.when(name.startswith("scope"), "scope").when(name.startswith("get") & name.endswith("Attribute"), "accessor")
        .when(name.startswith("set") & name.endswith("Attribute"), "mutator").when(relation, "relation").otherwise("method")
    )
    methods = G.with_sources(g, g.edges_of("part_of")).select("project_slug", F.col("target").alias("model"), name.alias("method"), category.alias("category"))
    policy = G.with_sources(g, g.edges_of("applies_to")).select("project_slug", F.col("target").alias("model"), "edge_seq", G.class_fqn(F.regexp_replace("source", "^policy:", "class:")).alias("policy"))
    observed = g.edges_of("observes").groupBy("project_slug", F.col("target").alias("model")).agg(joined(G.class_fqn(F.col("source"))).alias("observers"))
    # Without OBSERVES edges: observers of the project whose id holds the model's short name (a heuristic). Candidates share the
    # three characters the name begins with, so that no model is compared with every observer and an id gives one row a character.
    seeds = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("observer")), lambda i: F.substr("observer", i, F.lit(3)))))
    guess = g.of_kind("observer").select("project_slug", F.col("id").alias("observer")).where("observer <> ''").select("project_slug", "observer", seeds.alias("seed"))
    short = F.col("short")
    by_seed = models.where(F.length(short) >= 3).withColumn("seed", F.substr(short, F.lit(1), F.lit(3)))
    by_less = models.where(F.length(short).between(1, 2)).join(g.of_kind("observer").select("project_slug", F.col("id").alias("observer")), "project_slug").where(F.contains("observer", short))
    guess = by_seed.join(guess, ["project_slug", "seed"]).where(F.contains("observer", short)).select(*by_less.columns).unionByName(by_less)
    guess = guess.groupBy("project_slug", "model").agg(joined(G.class_fqn(F.col("observer"))).alias("guessed"))
    rows = models.join(methods, ["project_slug", "model"], "left").join(G.first_edge(policy, ["project_slug", "model"], "policy"), ["project_slug", "model"], "left")
    rows = rows.join(observed, ["project_slug", "model"], "left").join(guess, ["project_slug", "model"], "left")
    return rows.select("project_slug", "model", "policy", F.coalesce("observers", "guessed", F.lit("")).alias("observers"), "method", "category")


def trace_route(g: Graph) -> DataFrame:
    """Each route with handler, middleware in edge order (text after the first colon), form request, the handler's effects and policies.

    ``handler_kind`` is controller for a known handler method, else what the route says, if it leads nowhere at all.
    """
    routes = g.of_kind("route").select("project_slug", F.col("id").alias("route_id"), _uri(F.col("name")).alias("uri"), _verbs().alias("methods"), F.col("a.name").alias("name"), F.col("a.action_kind").alias("action_kind"))
    mw = g.edges_of("has_middleware").groupBy("project_slug", F.col("source").alias("route_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_seq", "target"))), lambda x: F.regexp_replace(x["target"], "^[^:]*:", "")), ",").alias("middleware"))
    handler = _handlers(g)
    kinds = (("fires", "fires"), ("dispatches", "dispatches"), ("notifies", "notifies"), ("returns_view", "views"))
    effects = G.with_targets(g, g.edges_of(*[k for k, _ in kinds], "validates_with")).withColumnRenamed("source", "method_id")
    effects = handler.select("project_slug", "method_id").distinct().join(effects, ["project_slug", "method_id"]).groupBy("project_slug", "method_id").agg(
        *[joined(F.when(F.col("kind") == k, F.col("target_name"))).alias(n) for k, n in kinds],
        F.min_by(F.coalesce("target_a.fqn", "target_name"), F.when(F.col("kind") == "validates_with", F.col("edge_seq"))).alias("form_request"),
    )
    policies = G.with_sources(g, g.edges_of("applies_to")).groupBy("project_slug", F.col("target").alias("handler_id")).agg(joined(F.col("source_name")).alias("policies"))
    owners = g.of_kind(*G.LISTABLE_KINDS).where(F.col("id").startswith("class:")).select("project_slug", F.col("id").alias("handler_id"), F.col("a.file").alias("handler_file"))
    leads = g.edges_of("routes_to").select("project_slug", F.col("source").alias("route_id"), F.lit(True).alias("leads")).distinct()
    rows = routes.join(mw, ["project_slug", "route_id"], "left").join(handler, ["project_slug", "route_id"], "left").join(effects, ["project_slug", "method_id"], "left")
    rows = rows.join(leads, ["project_slug", "route_id"], "left").withColumn("handler_id", F.concat(F.lit("class:"), "handler"))
    rows = rows.join(owners, ["project_slug", "handler_id"], "left").join(policies, ["project_slug", "handler_id"], "left")
    kind = F.when(F.col("method_id").isNotNull(), "controller").when(F.col("leads").isNull(), F.nullif("action_kind", F.lit("")))
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("middleware", "fires", "dispatches", "notifies", "views", "policies")]
    return rows.select("project_slug", "route_id", "uri", "methods", "name", "handler", "handler_method", "handler_line", "handler_file", kind.alias("handler_kind"), "form_request", *text)


def listeners(g: Graph) -> DataFrame:
    """(project_slug, event, listener_id, listener_fqn, short_name, method, queued, file, source, position) per event, in order."""
    edges = G.with_sources(g, g.edges_of("listens_to"))
    event = G.bare_event(F.col("target"))
    running = F.row_number().over(Window.partitionBy("project_slug", event).orderBy("edge_seq")) - 1
    fqn = F.coalesce("source_a.class_fqn", "source_a.fqn", F.regexp_extract("source", r"^listener:(.*)::[^:]*$", 1))
    method = F.coalesce("source_a.method", F.nullif(F.regexp_extract("source", r"^listener:.*::([^:]*)$", 1), F.lit("")))
    return edges.select("project_slug", event.alias("event"), F.col("source").alias("listener_id"), fqn.alias("listener_fqn"), F.col("source_name").alias("short_name"), method.alias("method"), F.coalesce("source_a.queued", F.lit(False)).alias("queued"), F.col("source_a.file").alias("file"), F.col("e.source").alias("source"), F.coalesce("e.order", running).alias("position"))


def dispatch_sites(g: Graph, kind: str) -> DataFrame:
    """(project_slug, target, class_fqn, method, file, line) of every edge of a kind; file and line of the call site if known."""
    sites = G.with_sources(g, g.edges_of(kind))
    return sites.select("project_slug", G.bare_event(F.col("target")).alias("subject"), F.col("source_a.class_fqn").alias("class_fqn"), F.col("source_name").alias("method"), F.coalesce("e.file", "source_a.file").alias("file"), F.coalesce("e.line", "source_a.line").alias("line"))


def find_dispatchers(g: Graph) -> DataFrame:
    return dispatch_sites(g, "fires").withColumnRenamed("subject", "event")


def find_jobs_dispatching(g: Graph) -> DataFrame:
    return dispatch_sites(g, "dispatches").withColumnRenamed("subject", "job")


def find_handlers(g: Graph, uri_glob: str | None = None, method: str | None = None, handler_fqn: str | None = None) -> DataFrame:
    if uri_glob is None and handler_fqn is None and method is not None:
        raise ValueError("missing_filter")
    rows = g.of_kind("route").withColumnRenamed("id", "route_id").join(_handlers(g), ["project_slug", "route_id"], "left")
    files = g.nodes.where(F.col("id").startswith("class:")).select("project_slug", F.substr("id", F.lit(7)).alias("handler"), F.col("a.file").alias("file"))
    rows = rows.join(files, ["project_slug", "handler"], "left")
    if uri_glob:
        rows = rows.where(matches_uri_glob(_uri(F.col("name")), uri_glob))
    if method:
        rows = rows.where(F.array_contains("a.methods", method.upper()))
    if handler_fqn:
        cls, _, m = handler_fqn.partition("::")
        rows = rows.where((F.col("handler") == cls) & ((F.col("handler_method") == m) if m else F.lit(True)))
    return rows.select("project_slug", "route_id", _uri(F.col("name")).alias("uri"), _verbs().alias("methods"), F.col("a.name").alias("route_name"), F.col("a.action_kind").alias("action_kind"), F.col("handler").alias("class_fqn"), F.col("handler_method").alias("method"), "file", F.col("handler_line").alias("line"))


def get_policy_for(g: Graph) -> DataFrame:
    """(project_slug, model, policy_fqn, short_name, file, methods): the first policy of each model; methods through either id."""
    first = G.with_sources(g, g.edges_of("applies_to")).select("project_slug", F.col("target").alias("model"), "edge_seq", F.col("source").alias("policy_id"), F.col("source_name").alias("short_name"), F.coalesce("source_a.policy", "source_a.fqn").alias("stated"), F.col("source_a.file").alias("file"))
    first = G.first_edge(first, ["project_slug", "model"], "policy_id", "short_name", "stated", "file")
    bare = F.regexp_replace("policy_id", "^(policy|class):", "")
    members = G.with_sources(g, g.edges_of("part_of")).select("project_slug", F.regexp_replace("target", "^(policy|class):", "").alias("bare"), "source_name")
    members = members.groupBy("project_slug", "bare").agg(joined(F.col("source_name"), distinct=False).alias("methods"))
    return first.withColumn("bare", bare).join(members, ["project_slug", "bare"], "left").select("project_slug", "model", F.coalesce("stated", "bare").alias("policy_fqn"), "short_name", "file", F.coalesce("methods", F.lit("")).alias("methods"))


def resolve_binding(g: Graph) -> DataFrame:
    first = G.first_edge(g.edges_of("bound_to").select("project_slug", F.col("source").alias("id"), "edge_seq", "target"), ["project_slug", "id"], "target")
    rows = g.of_kind("binding").join(first, ["project_slug", "id"], "left")
    return rows.select("project_slug", F.regexp_replace("id", "^binding:", "").alias("abstract"), F.coalesce(G.class_fqn(F.col("target")), "a.concrete_class").alias("concrete_class"), F.col("a.concrete_kind").alias("concrete_kind"), F.coalesce("a.shared", F.lit(False)).alias("shared"), F.col("a.concrete_file").alias("file"), F.col("a.concrete_line").alias("line"))


def find_implementations(g: Graph, include_subclasses: bool = True) -> DataFrame:
    kinds = ["implements", "extends"] if include_subclasses else ["implements"]
    rows = G.with_sources(g, g.edges_of(*kinds))
    return rows.select("project_slug", G.class_fqn(F.col("target")).alias("interface"), G.class_fqn(F.col("source")).alias("fqn"), F.col("source_name").alias("short_name"), F.col("source_a.file").alias("file"), F.col("kind").alias("via"))


def find_callers(g: Graph) -> DataFrame:
    rows = G.with_sources(g, g.edges_of("calls"))
    line = F.coalesce(F.nullif("e.line", F.lit(0)), "source_a.line")
    return rows.select("project_slug", F.col("target").alias("method_id"), F.col("source_a.class_fqn").alias("class_fqn"), F.col("source_name").alias("method"), F.coalesce(F.nullif(F.col("e.file"), F.lit("")), "source_a.file").alias("file"), line.alias("line"))


def find_cache_users(g: Graph, mode: str = "any", key_glob: str | None = None) -> DataFrame:
    kinds = {"any": ["cache_read", "cache_write"], "read": ["cache_read"], "write": ["cache_write"]}
    if mode not in kinds:
        raise ValueError(f"invalid_mode: {mode}")
    rows = G.with_sources(g, G.with_targets(g, g.edges_of(*kinds[mode])).where("target_kind = 'cache_key'"))
    if key_glob:
        rows = rows.where(matches_glob(F.col("target_name"), key_glob))
    return rows.select("project_slug", F.col("target_name").alias("key"), F.when(F.col("kind") == "cache_read", "read").otherwise("write").alias("mode"), F.col("source_a.class_fqn").alias("class_fqn"), F.col("source_name").alias("method"), F.coalesce("e.file", "source_a.file").alias("file"), F.coalesce(F.nullif("e.line", F.lit(0)), "source_a.line").alias("line"), F.col("e.form").alias("form"))


def cache_keys_matching(g: Graph, query: str) -> DataFrame:
    """Per project: the key itself if there is one, else those matching the glob, else those that contain the text."""
    keys = g.of_kind("cache_key").select("project_slug", F.col("name").alias("key"), (F.col("id") == f"cache_key:{query}").alias("exact"))
    loose = matches_glob(F.col("key"), query) if any(c in query for c in "*?[") else F.contains("key", F.lit(query))
    keys = keys.where(F.col("exact") | loose).withColumn("any_exact", F.max("exact").over(Window.partitionBy("project_slug")))
    return keys.where(~F.col("any_exact") | F.col("exact")).select("project_slug", "key").distinct()


def event_links(g: Graph) -> DataFrame:
    """(project_slug, event, listener, listener_fqn, child): an event's listeners and the events each fires, directly or by its method."""
    heard = listeners(g).select("project_slug", "event", "listener_id", F.col("short_name").alias("listener"), "listener_fqn", "method")
    fired = g.edges_of("fires").select("project_slug", "source", G.bare_event(F.col("target")).alias("child"))
    by = F.explode(F.array_distinct(F.array(F.col("listener_id"), F.concat(F.lit("method:"), "listener_fqn", F.lit("::"), F.coalesce("method", F.lit("handle"))))))
    links = heard.withColumn("source", by).join(fired, ["project_slug", "source"]).select("project_slug", "event", "listener_id", "child").distinct()
    return heard.drop("method").distinct().join(links, ["project_slug", "event", "listener_id"], "left").select("project_slug", "event", "listener", "listener_fqn", "child")


def find_event_chains(g: Graph, max_depth: int = 3) -> DataFrame:
    """(project_slug, root, depth, parent_event, listener, listener_fqn, child_event) of every event: who hears it and what follows."""
    links = event_links(g)
    root = links.select("project_slug", F.col("event").alias("root")).distinct()
    frontier, seen, out = root.withColumn("event", F.col("root")), root.withColumn("event", F.col("root")), []
    for depth in range(1, max_depth + 1):
        step = G.materialize(frontier.join(links, ["project_slug", "event"]).withColumn("depth", F.lit(depth)))
        out.append(step.select("project_slug", "root", "depth", F.col("event").alias("parent_event"), "listener", "listener_fqn", F.col("child").alias("child_event")))
        frontier = step.where("child IS NOT NULL").select("project_slug", "root", F.col("child").alias("event")).distinct().join(seen, ["project_slug", "root", "event"], "left_anti")
        seen = seen.unionByName(frontier)
        if depth < max_depth and not frontier.limit(1).count():
            break
    return reduce(DataFrame.unionByName, out)


def get_request_flow(g: Graph) -> DataFrame:
    """(project_slug, route_id, event, listener, fires, dispatches, notifies): what a route's handler fires, who hears it, and what they cause."""
    fired = G.with_targets(g, g.edges_of("fires")).select("project_slug", F.col("source").alias("method_id"), F.col("target_name").alias("event_name"), G.bare_event(F.col("target")).alias("event"))
    flow = _handlers(g).select("project_slug", "route_id", "method_id").join(fired, ["project_slug", "method_id"]).select("project_slug", "route_id", "event", "event_name").distinct()
    heard = listeners(g).select("project_slug", "event", "listener_id", F.col("short_name").alias("listener"), "listener_fqn", "method").distinct()
    by = F.explode(F.array_distinct(F.array(F.col("listener_id"), F.concat(F.lit("method:"), "listener_fqn", F.lit("::"), F.coalesce("method", F.lit("handle"))))))
    caused = G.with_targets(g, g.edges_of("fires", "dispatches", "notifies")).select("project_slug", "source", "kind", "target_name")
    caused = heard.select("project_slug", "listener_id", "listener_fqn", "method").distinct().withColumn("source", by).join(caused, ["project_slug", "source"]).groupBy("project_slug", "listener_id").agg(*[joined(F.when(F.col("kind") == k, F.col("target_name"))).alias(k) for k in ("fires", "dispatches", "notifies")])
    rows = flow.join(heard, ["project_slug", "event"], "left").join(caused, ["project_slug", "listener_id"], "left")
    return rows.select("project_slug", "route_id", F.col("event_name").alias("event"), "listener", *[F.coalesce(c, F.lit("")).alias(c) for c in ("fires", "dispatches", "notifies")])


def expand_call_tree(g: Graph, roots: DataFrame, direction: str = "downstream", max_depth: int = 3, max_nodes: int = 200) -> DataFrame:
    """The call tree of every root (project_slug, root): callees or callers in discovery order, with the call that led there."""
    if direction not in ("downstream", "upstream"):
        raise ValueError(f"invalid_direction: {direction}")
    ends = ("source", "target") if direction == "downstream" else ("target", "source")
    calls = g.edges_of("calls")
    steps = calls.select("project_slug", F.col(ends[0]).alias("source"), F.col(ends[1]).alias("target"), "edge_seq")
    found = G.walk(g, roots, steps, max_depth, max_nodes)
    sites = calls.select("edge_seq", F.col("e.file").alias("call_site_file"), F.col("e.line").alias("call_site_line"))
    node = g.nodes.select("project_slug", "id", F.col("a.class_fqn").alias("class_fqn"), F.col("name").alias("method"), F.col("a.line").alias("line"))
    return found.join(node, ["project_slug", "id"]).join(sites, "edge_seq", "left").select("project_slug", "root", "rank", "id", "class_fqn", "method", "line", "depth", "via", "call_site_file", "call_site_line")


def call_tree_limits(g: Graph, roots: DataFrame, direction: str = "downstream", max_depth: int = 3, max_nodes: int = 200) -> DataFrame:
    """(project_slug, root, nodes, truncated_reason) per root: how many nodes its tree reports, and which bound kept others out.

    ``max_nodes`` if the tree is full; else ``max_depth`` if a node at the last level was reached and some node of the tree has a
    neighbour outside it; null for a whole tree.
    """
    ends = ("source", "target") if direction == "downstream" else ("target", "source")
    per = ["project_slug", "root"]
    known = g.nodes.select("project_slug", "id")
    asked = roots.select(*per).distinct().join(known.withColumnRenamed("id", "root"), per, "left_semi")
    tree = expand_call_tree(g, roots, direction, max_depth, max_nodes).select(*per, "id", "depth")
    tree = tree.unionByName(asked.select(*per, F.col("root").alias("id"), F.lit(0).alias("depth")))
    steps = g.edges_of("calls").select("project_slug", F.col(ends[0]).alias("id"), F.col(ends[1]).alias("next"))
    steps = steps.join(known.withColumnRenamed("id", "next"), ["project_slug", "next"], "left_semi").distinct()
    beyond = tree.join(steps, ["project_slug", "id"]).select(*per, F.col("next").alias("id")).distinct().join(tree, [*per, "id"], "left_anti")
    beyond = beyond.groupBy(*per).agg(F.lit(True).alias("more"))
    size = tree.groupBy(*per).agg((F.count("*") - 1).alias("nodes"), F.max("depth").alias("deepest"))
    reason = F.when(F.col("nodes") >= max_nodes, "max_nodes").when((F.col("deepest") >= max_depth) & F.col("more"), "max_depth")
    return size.join(beyond, per, "left").select(*per, "nodes", reason.alias("truncated_reason"))


def describe_flow(g: Graph, query: str, max_candidates: int = 10) -> DataFrame:
    """Routes that fit a loose description, best first per project; ``winner`` marks an unambiguous one."""
    low = query.lower().lstrip("/")
    words = [t for t in query.lower().replace("/", " ").replace("\\", " ").split() if t not in STOP_WORDS and len(t) >= 2]
    rows = g.of_kind("route").withColumnRenamed("id", "route_id").join(_handlers(g), ["project_slug", "route_id"], "left")
    rows = rows.select("project_slug", "route_id", _uri(F.col("name")).alias("uri"), _verbs().alias("methods"), F.col("a.name").alias("name"), "handler", "handler_method")
    uri, name, handler = F.regexp_replace(F.lower("uri"), "^/+", ""), F.lower("name"), F.lower("handler")
    inside = lambda c: (c != "") & F.lit(low != "") & F.contains(c, F.lit(low))
    rank = (
        F.when((uri == low) & (uri != ""), 0).when((name == low) & (name != ""), 1).when(inside(uri), 2).when(inside(name), 3)
        .when(F.lower(F.substring_index("handler", "\\", -1)) == low, 4)
    )
    hay = F.concat_ws(" ", F.nullif(uri, F.lit("")), F.nullif(name, F.lit("")), F.nullif(handler, F.lit("")))
    score = reduce(lambda a, b: a + b, [F.contains(hay, F.lit(t)).cast("int") for t in words], F.lit(0))
    rows = rows.withColumns({"score": score, "rank": F.coalesce(rank, F.when(score > 0, 5))}).where("rank IS NOT NULL").withColumn("score", F.greatest("score", F.lit(1)))
    by = Window.partitionBy("project_slug")
    rows = rows.withColumns({"position": F.row_number().over(by.orderBy("rank", F.desc("score"), "uri", "route_id")), "peers": F.count("*").over(Window.partitionBy("project_slug", "rank")), "candidates": F.count("*").over(by)})
    quality = F.element_at(F.array(*[F.lit(q) for q in ("exact_uri", "exact_name", "uri_substring", "name_substring", "handler_class", "token_overlap")]), F.col("rank") + 1)
    winner = (F.col("position") == 1) & ((F.col("candidates") == 1) | ((F.col("rank") <= 1) & (F.col("peers") == 1)))
    return rows.where(F.col("position") <= max_candidates).select("project_slug", "position", "route_id", "uri", "methods", "name", F.col("handler").alias("handler_fqn"), "handler_method", quality.alias("match_quality"), "score", winner.alias("winner"))
