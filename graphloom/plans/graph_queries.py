"""Graph queries over the driver's tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.plans import tools as T


def _on_graph(f):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return f(G.load_graph(spark, d))

    return query


def _call_trees(g: G.Graph, direction: str) -> DataFrame:
    """Downstream from every caller, upstream from everything called."""
    roots = g.edges_of("calls").select("project_slug", F.col("source" if direction == "downstream" else "target").alias("root")).distinct()
    return T.expand_call_tree(g, roots, direction, max_depth=3, max_nodes=200).select("project_slug", "root", "rank", "id", "depth", "via", "call_site_line")


def _bfs(g: G.Graph, **bounds: int) -> DataFrame:
    roots = g.of_kind("route").select("project_slug", F.col("id").alias("root"))
    return G.bfs(g, roots, ["routes_to", "calls", "part_of", "fires"], **bounds).select("project_slug", "root", "rank", "id", "depth")


def _dangling(g: G.Graph) -> DataFrame:
    known = g.nodes.select("project_slug", F.col("id").alias("target"), F.lit(1).alias("hit"))
    return g.edges.join(known, ["project_slug", "target"], "left").groupBy("kind").agg(F.count("*").alias("edges"), F.count_if(F.col("hit").isNull()).alias("dangling"))


QUERIES = {
    "list_routes": _on_graph(T.list_routes),
    "list_routes_filtered": _on_graph(lambda g: T.list_routes(g, method="get", uri_glob="/*/{id}*", middleware="auth.badge")),
    "list_by_kind": _on_graph(T.list_by_kind),
    "list_by_kind_page": _on_graph(lambda g: T.list_by_kind(g, "controller", name_glob="*Controller", namespace_prefix="App\\", offset=2, limit=5)),
    "list_modules": _on_graph(T.list_modules),
    "describe_module": _on_graph(lambda g: T.describe_module(g, "App\\Billing")),
    "module_routes": _on_graph(lambda g: T.module_routes(g, "App\\Billing")),
    "explore_entity": _on_graph(lambda g: T.explore_entity(g, "ledger")),
    "describe_class": _on_graph(T.describe_class),
    "class_cache_keys": _on_graph(T.class_cache_keys),
    "get_model_context": _on_graph(T.get_model_context),
    "trace_route": _on_graph(T.trace_route),
    "get_request_flow": _on_graph(T.get_request_flow),
    "describe_flow": _on_graph(lambda g: T.describe_flow(g, "how is the ledger of /billing listed")),
    "find_handlers": _on_graph(T.find_handlers),
    "find_listeners": _on_graph(T.listeners),
    "find_dispatchers": _on_graph(T.find_dispatchers),
    "find_event_chains": _on_graph(T.find_event_chains),
    "find_jobs_dispatching": _on_graph(T.find_jobs_dispatching),
    "get_policy_for": _on_graph(T.get_policy_for),
    "find_implementations": _on_graph(T.find_implementations),
    "find_callers": _on_graph(T.find_callers),
    "find_cache_users": _on_graph(T.find_cache_users),
    "cache_keys_matching": _on_graph(lambda g: T.cache_keys_matching(g, "*.list")),
    "expand_call_tree": _on_graph(lambda g: _call_trees(g, "downstream")),
    "expand_call_tree_upstream": _on_graph(lambda g: _call_trees(g, "upstream")),
    "call_tree_limits": _on_graph(lambda g: T.call_tree_limits(g, g.edges_of("calls").select("project_slug", F.col("source").alias("root")))),
    "bfs": _on_graph(_bfs),
    "dangling_edges": _on_graph(_dangling),
}

_N = """
n AS (SELECT project_slug, id, kind, name, CASE WHEN json_valid(attributes) THEN attributes END AS a FROM (
        SELECT *, row_number() OVER (PARTITION BY project_slug, id ORDER BY kind NULLS FIRST, name NULLS FIRST, attributes NULLS FIRST) AS r FROM nodes) WHERE r = 1),
e AS (SELECT edge_seq, project_slug, source, target, kind, CASE WHEN json_valid(attributes) THEN attributes END AS a FROM edges),
out AS (SELECT e.edge_seq, e.project_slug, e.source, e.target, e.kind, e.a AS ea, n.kind AS tkind, n.name AS tname, n.a AS ta FROM e JOIN n ON n.project_slug = e.project_slug AND n.id = e.target),
inc AS (SELECT e.edge_seq, e.project_slug, e.source, e.target, e.kind, e.a AS ea, n.kind AS skind, n.name AS sname, n.a AS sa FROM e JOIN n ON n.project_slug = e.project_slug AND n.id = e.source),
h AS (SELECT project_slug, source AS route_id, arg_min(target, edge_seq) AS method_id, arg_min(coalesce(ta->>'$.class_fqn', chr(0)), edge_seq) AS hc, arg_min(tname, edge_seq) AS handler_method,
             arg_min(coalesce(ta->>'$.line', chr(0)), edge_seq) AS hl FROM out WHERE kind = 'routes_to' GROUP BY ALL),
hh AS (SELECT project_slug, route_id, method_id, nullif(hc, chr(0)) AS handler, handler_method, TRY_CAST(nullif(hl, chr(0)) AS INT) AS handler_line FROM h),
routes AS (SELECT project_slug, id AS route_id, coalesce(nullif(a->>'$.uri', ''), name) AS uri, a->>'$.name' AS name, a->>'$.action_kind' AS action_kind,
                  coalesce(array_to_string(CAST(a->'$.methods' AS VARCHAR[]), ','), '') AS methods FROM n WHERE kind = 'route')"""
_KINDS = ", ".join(f"'{k}'" for k in G.LISTABLE_KINDS)
_SEARCH = ", ".join(f"'{k}'" for k in T.SEARCHABLE_KINDS)
_BARE = "regexp_replace({0}, '^(event|class):', '')"
_FQN = "CASE WHEN starts_with({0}, 'class:') THEN substr({0}, 7) ELSE {1} END"
_LIST_ROUTES = """
SELECT r.project_slug, r.route_id, r.uri, r.methods, r.name, controller, method, coalesce(nullif(action_kind, ''), 'unknown') AS action_kind, coalesce(middleware, '') AS middleware
FROM routes r LEFT JOIN (
  SELECT project_slug, source AS route_id, string_agg(tname, ',' ORDER BY tname) FILTER (kind = 'has_middleware') AS middleware,
         arg_max(ta->>'$.class_fqn', edge_seq) FILTER (kind = 'routes_to' AND ta->>'$.class_fqn' IS NOT NULL) AS controller, arg_max(tname, edge_seq) FILTER (kind = 'routes_to') AS method
  FROM out WHERE kind IN ('routes_to', 'has_middleware') GROUP BY ALL) t USING (project_slug, route_id)"""
_CLASSES = f"cls AS (SELECT project_slug, kind, substr(id, 7) AS fqn, name AS short_name, a->>'$.file' AS file, a->>'$.namespace' AS namespace FROM n WHERE starts_with(id, 'class:') AND kind IN ({_KINDS}))"


def _tree(kind: str, parent: str, child: str, end: str = "target") -> str:
    """Three levels of a breadth-first walk from one end of the edges of a kind, first discovery by the discoverer's rank and the edge's order."""
    steps = f"""
steps AS (SELECT e.project_slug, e.{parent} AS p, e.{child} AS c, e.edge_seq FROM e JOIN n ON n.project_slug = e.project_slug AND n.id = e.{child} WHERE e.kind = 'calls'),
l0 AS (SELECT DISTINCT e.project_slug, e.{end} AS root, e.{end} AS id, CAST(-1 AS BIGINT) AS rank FROM e JOIN n ON n.project_slug = e.project_slug AND n.id = e.{end} WHERE e.kind = '{kind}')"""
    levels = []
    for d in (1, 2, 3):
        seen = " UNION ALL ".join(f"SELECT project_slug, root, id FROM l{i}" for i in range(d))
        done = " UNION ALL ".join(f"SELECT project_slug, root FROM l{i}" for i in range(1, d)) or "SELECT NULL AS project_slug, NULL AS root WHERE false"
        levels.append(f"""
c{d} AS (SELECT l.project_slug, l.root, s.c AS id, min((l.rank, s.edge_seq, l.id)) AS best FROM l{d - 1} l JOIN steps s ON s.project_slug = l.project_slug AND s.p = l.id
        WHERE NOT EXISTS (SELECT 1 FROM ({seen}) v WHERE v.project_slug = l.project_slug AND v.root = l.root AND v.id = s.c) GROUP BY ALL),
l{d} AS (SELECT * FROM (SELECT c.project_slug, c.root, c.id, {d} AS depth, best[3] AS via, best[2] AS edge_seq,
               coalesce(t.k, 0) + row_number() OVER (PARTITION BY c.project_slug, c.root ORDER BY best[1], best[2], c.id) - 1 AS rank
        FROM c{d} c LEFT JOIN (SELECT project_slug, root, count(*) AS k FROM ({done}) GROUP BY ALL) t USING (project_slug, root)) WHERE rank < 200)""")
    every = " UNION ALL ".join(f"SELECT project_slug, root, rank, id, depth, via, edge_seq FROM l{d}" for d in (1, 2, 3))
    return f"WITH {_N}, {steps}, {','.join(levels)} SELECT x.project_slug, root, rank, x.id, depth, via, TRY_CAST(e.a->>'$.line' AS INT) AS call_site_line FROM ({every}) x LEFT JOIN e USING (edge_seq)"


def _bfs_sql(depth: int, limit: int) -> str:
    """Levels of a breadth-first walk from every route, the root included."""
    steps = """
steps AS (SELECT e.project_slug, e.source AS p, e.target AS c, e.edge_seq FROM e JOIN n ON n.project_slug = e.project_slug AND n.id = e.target WHERE e.kind IN ('routes_to', 'calls', 'part_of', 'fires')),
l0 AS (SELECT project_slug, id AS root, id, CAST(0 AS BIGINT) AS rank, 0 AS depth FROM n WHERE kind = 'route')"""
    levels = []
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT project_slug, root, id FROM l{i}" for i in range(d))
        levels.append(f"""
c{d} AS (SELECT l.project_slug, l.root, s.c AS id, min((l.rank, s.edge_seq, l.id)) AS best FROM l{d - 1} l JOIN steps s ON s.project_slug = l.project_slug AND s.p = l.id
        WHERE NOT EXISTS (SELECT 1 FROM ({seen}) v WHERE v.project_slug = l.project_slug AND v.root = l.root AND v.id = s.c) GROUP BY ALL),
l{d} AS (SELECT * FROM (SELECT c.project_slug, c.root, c.id, t.k + row_number() OVER (PARTITION BY c.project_slug, c.root ORDER BY best[1], best[2], c.id) - 1 AS rank, {d} AS depth
        FROM c{d} c JOIN (SELECT project_slug, root, count(*) AS k FROM ({seen}) GROUP BY ALL) t USING (project_slug, root)) WHERE rank < {limit})""")
    every = " UNION ALL ".join(f"SELECT project_slug, root, rank, id, depth FROM l{d}" for d in range(depth + 1))
    return f"WITH {_N}, {steps}, {','.join(levels)} {every}"


def _effects(names: list[tuple[str, str]]) -> str:
    return ", ".join(f"coalesce(string_agg(DISTINCT tname, ',' ORDER BY tname) FILTER (kind = '{k}'), '') AS {n}" for k, n in names)


_LISTENERS = f"""
lis AS (SELECT project_slug, {_BARE.format('target')} AS event, source AS listener_id, coalesce(sa->>'$.class_fqn', sa->>'$.fqn', regexp_extract(source, '^listener:(.*)::[^:]*$', 1)) AS listener_fqn,
               sname AS short_name, coalesce(sa->>'$.method', nullif(regexp_extract(source, '^listener:.*::([^:]*)$', 1), '')) AS method, coalesce(TRY_CAST(sa->>'$.queued' AS BOOLEAN), false) AS queued, sa->>'$.file' AS file, ea->>'$.source' AS source,
               coalesce(TRY_CAST(ea->>'$.order' AS INT), row_number() OVER (PARTITION BY project_slug, {_BARE.format('target')} ORDER BY edge_seq) - 1) AS position FROM inc WHERE kind = 'listens_to')"""

ORACLE = {
    "list_routes": f"WITH {_N} {_LIST_ROUTES}",
    "list_routes_filtered": f"WITH {_N} SELECT * FROM ({_LIST_ROUTES}) WHERE list_contains(string_split(methods, ','), 'GET') AND regexp_matches(ltrim(uri, '/'), '(?s)^.*/\\{{id\\}}.*$') AND list_contains(string_split(middleware, ','), 'auth.badge')",
    "list_by_kind": f"WITH {_N}, {_CLASSES} SELECT *, row_number() OVER (PARTITION BY project_slug, kind ORDER BY fqn) - 1 AS position FROM cls",
    "list_by_kind_page": f"WITH {_N}, {_CLASSES} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_slug ORDER BY fqn) - 1 AS position FROM cls WHERE kind = 'controller' AND ends_with(short_name, 'Controller') AND starts_with(fqn, 'App\\')) WHERE position >= 2 AND position < 7",
    "list_modules": f"""WITH {_N}, {_CLASSES},
m AS (SELECT project_slug, kind, CASE WHEN regexp_extract(fqn, '^((?:[^\\\\]+\\\\)*?(?:Modules|Module)\\\\[^\\\\]+)\\\\', 1) <> '' THEN regexp_extract(fqn, '^((?:[^\\\\]+\\\\)*?(?:Modules|Module)\\\\[^\\\\]+)\\\\', 1)
             ELSE array_to_string(string_split(fqn, '\\')[1:2], '\\') END AS prefix FROM cls WHERE contains(fqn, '\\')),
k AS (SELECT project_slug, prefix, kind, count(*) AS c FROM m GROUP BY ALL)
SELECT project_slug, prefix, CAST(sum(c) AS BIGINT) AS class_count, string_agg(kind || ':' || c, ',' ORDER BY kind || ':' || c) AS kinds FROM k GROUP BY ALL HAVING sum(c) >= 2""",
    "describe_module": f"""WITH {_N}, {_CLASSES},
m AS (SELECT *, substr(fqn, 13) AS rest, row_number() OVER (PARTITION BY project_slug, kind ORDER BY fqn) AS r FROM cls WHERE starts_with(fqn, 'App\\Billing\\'))
SELECT project_slug, kind, count(*) AS total, string_agg(fqn, ',' ORDER BY fqn) FILTER (r <= 5) AS fqns,
       coalesce(string_agg(DISTINCT string_split(rest, '\\')[1], ',' ORDER BY string_split(rest, '\\')[1]) FILTER (contains(rest, '\\')), '') AS submodules FROM m GROUP BY ALL""",
    "module_routes": f"WITH {_N} SELECT project_slug, uri, methods, name, handler AS handler_fqn FROM routes JOIN hh USING (project_slug, route_id) WHERE starts_with(handler, 'App\\Billing\\')",
    "explore_entity": f"""WITH {_N}, {_CLASSES},
m AS (SELECT *, CASE WHEN fqn = 'ledger' THEN 0 WHEN lower(short_name) = 'ledger' THEN 1 WHEN starts_with(lower(short_name), 'ledger') THEN 2 WHEN contains(lower(fqn), 'ledger') THEN 3 END AS q FROM cls WHERE kind IN ({_SEARCH}))
SELECT * FROM (SELECT project_slug, kind, count(*) OVER (PARTITION BY project_slug, kind) AS total, row_number() OVER (PARTITION BY project_slug, kind ORDER BY q, fqn) AS position, fqn, short_name,
  ['exact_fqn', 'exact_name', 'prefix', 'substring'][q + 1] AS match_quality FROM m WHERE q IS NOT NULL) WHERE position <= 10""",
    "describe_class": f"""WITH {_N},
own AS (SELECT project_slug, target AS class_id, source AS member, sname FROM inc WHERE kind = 'part_of'),
meth AS (SELECT project_slug, class_id, string_agg(sname, ',' ORDER BY sname) AS methods FROM own GROUP BY ALL),
eff AS (SELECT o.project_slug, class_id, {_effects([('fires', 'fires'), ('dispatches', 'dispatches'), ('notifies', 'notifies'), ('returns_view', 'views')])}
        FROM own o JOIN out ON out.project_slug = o.project_slug AND out.source = o.member GROUP BY ALL),
rts AS (SELECT o.project_slug, class_id, string_agg(DISTINCT r.uri, ',' ORDER BY r.uri) AS routes FROM own o JOIN e ON e.project_slug = o.project_slug AND e.target = o.member AND e.kind = 'routes_to'
        JOIN (SELECT project_slug, id, coalesce(nullif(a->>'$.uri', ''), name) AS uri FROM n) r ON r.project_slug = e.project_slug AND r.id = e.source GROUP BY ALL),
up AS (SELECT project_slug, source AS class_id, string_agg(DISTINCT f, ',' ORDER BY f) FILTER (kind = 'implements') AS interfaces, string_agg(DISTINCT f, ',' ORDER BY f) FILTER (kind = 'uses_trait') AS traits
       FROM (SELECT e.project_slug, e.source, e.kind, {_FQN.format('e.target', 'coalesce(n.name, e.target)')} AS f FROM e LEFT JOIN n ON n.project_slug = e.project_slug AND n.id = e.target WHERE e.kind IN ('implements', 'uses_trait')) GROUP BY ALL),
par AS (SELECT p.project_slug, p.class_id, coalesce(nullif(n.a->>'$.fqn', ''), n.name) AS parent FROM (SELECT project_slug, source AS class_id, arg_min(target, edge_seq) AS target FROM e WHERE kind = 'extends' GROUP BY ALL) p JOIN n ON n.project_slug = p.project_slug AND n.id = p.target),
pol AS (SELECT project_slug, target AS class_id, string_agg(DISTINCT sname, ',' ORDER BY sname) AS policies FROM inc WHERE kind = 'applies_to' GROUP BY ALL)
SELECT n.project_slug, n.id AS class_id, coalesce(a->>'$.fqn', substr(id, 7)) AS fqn, n.name AS short_name, a->>'$.namespace' AS namespace, a->>'$.file' AS file, n.kind,
       coalesce(TRY_CAST(a->>'$.abstract' AS BOOLEAN), false) AS abstract, coalesce(TRY_CAST(a->>'$.final' AS BOOLEAN), false) AS final, TRY_CAST(a->>'$.readonly' AS BOOLEAN) AS readonly, parent,
       coalesce(interfaces, '') AS interfaces, coalesce(traits, '') AS traits, coalesce(methods, '') AS methods, coalesce(routes, '') AS routes, coalesce(fires, '') AS fires, coalesce(dispatches, '') AS dispatches,
       coalesce(notifies, '') AS notifies, coalesce(views, '') AS views, coalesce(policies, '') AS policies,
       coalesce(CASE WHEN json_type(a, '$.cases') = 'ARRAY' THEN len(list_filter(CAST(a->'$.cases' AS JSON[]), lambda c: c->>'$.name' IS NOT NULL)) END, 0) AS case_count,
       CASE WHEN json_type(a, '$.cases') = 'ARRAY' THEN array_to_string(list_transform(list_filter(CAST(a->'$.cases' AS JSON[]), lambda c: c->>'$.name' IS NOT NULL), lambda c: (c->>'$.name') || coalesce('=' || (c->>'$.value'), '')), ',') END AS cases,
       CASE WHEN json_type(a, '$.kinds') = 'ARRAY' THEN array_to_string(CAST(a->'$.kinds' AS VARCHAR[]), ',') END AS kinds,
       CASE WHEN json_type(a, '$.interfaces_inherited') = 'ARRAY' THEN array_to_string(list_sort(CAST(a->'$.interfaces_inherited' AS VARCHAR[])), ',') END AS interfaces_inherited
FROM n LEFT JOIN meth ON meth.project_slug = n.project_slug AND meth.class_id = n.id LEFT JOIN eff ON eff.project_slug = n.project_slug AND eff.class_id = n.id LEFT JOIN rts ON rts.project_slug = n.project_slug AND rts.class_id = n.id
LEFT JOIN up ON up.project_slug = n.project_slug AND up.class_id = n.id LEFT JOIN par ON par.project_slug = n.project_slug AND par.class_id = n.id LEFT JOIN pol ON pol.project_slug = n.project_slug AND pol.class_id = n.id
WHERE starts_with(n.id, 'class:') AND n.kind IN ({_KINDS})""",
    "class_cache_keys": f"""WITH {_N}, own AS (SELECT project_slug, target AS class_id, source FROM e WHERE kind = 'part_of')
SELECT project_slug, class_id, tname AS key, CASE WHEN bool_or(kind = 'cache_read') AND bool_or(kind = 'cache_write') THEN 'both' WHEN bool_or(kind = 'cache_write') THEN 'write' ELSE 'read' END AS mode,
       arg_min(ea->>'$.form', edge_seq) FILTER (ea->>'$.form' IS NOT NULL) AS form FROM out JOIN own USING (project_slug, source) WHERE kind IN ('cache_read', 'cache_write') GROUP BY ALL""",
    "get_model_context": f"""WITH {_N},
m AS (SELECT project_slug, id AS model, name AS short FROM n WHERE kind = 'model'),
pol AS (SELECT project_slug, target AS model, arg_min({_FQN.format("regexp_replace(source, '^policy:', 'class:')", "source")}, edge_seq) AS policy FROM inc WHERE kind = 'applies_to' GROUP BY ALL),
obs AS (SELECT project_slug, target AS model, string_agg(DISTINCT {_FQN.format('source', 'source')}, ',' ORDER BY {_FQN.format('source', 'source')}) AS observers FROM e WHERE kind = 'observes' GROUP BY ALL),
gue AS (SELECT m.project_slug, model, string_agg(DISTINCT substr(o.id, 7), ',' ORDER BY substr(o.id, 7)) AS guessed FROM m JOIN n o ON o.project_slug = m.project_slug AND o.kind = 'observer' AND contains(o.id, m.short) GROUP BY ALL)
SELECT m.project_slug, m.model, policy, coalesce(observers, guessed, '') AS observers, i.sname AS method,
       CASE WHEN i.sname IS NULL THEN 'method' WHEN starts_with(i.sname, 'scope') THEN 'scope' WHEN starts_with(i.sname, 'get') AND ends_with(i.sname, 'Attribute') THEN 'accessor' WHEN starts_with(i.sname, 'set') AND ends_with(i.sname, 'Attribute') THEN 'mutator'
            WHEN regexp_matches(coalesce(i.sa->>'$.return_type', ''), '{"|".join(T.RELATIONS)}') THEN 'relation' ELSE 'method' END AS category
FROM m LEFT JOIN (SELECT * FROM inc WHERE kind = 'part_of') i ON i.project_slug = m.project_slug AND i.target = m.model
LEFT JOIN pol ON pol.project_slug = m.project_slug AND pol.model = m.model LEFT JOIN obs ON obs.project_slug = m.project_slug AND obs.model = m.model LEFT JOIN gue ON gue.project_slug = m.project_slug AND gue.model = m.model""",
    "trace_route": f"""WITH {_N},
mw AS (SELECT project_slug, source AS route_id, string_agg(regexp_replace(target, '^[^:]*:', ''), ',' ORDER BY edge_seq, target) AS middleware FROM e WHERE kind = 'has_middleware' GROUP BY ALL),
eff AS (SELECT project_slug, source AS method_id, {_effects([('fires', 'fires'), ('dispatches', 'dispatches'), ('notifies', 'notifies'), ('returns_view', 'views')])},
        arg_min(coalesce(ta->>'$.fqn', tname), edge_seq) FILTER (kind = 'validates_with') AS form_request FROM out WHERE kind IN ('fires', 'dispatches', 'notifies', 'returns_view', 'validates_with') GROUP BY ALL)
SELECT r.project_slug, r.route_id, uri, methods, r.name, handler, handler_method, handler_line, form_request, coalesce(middleware, '') AS middleware, coalesce(fires, '') AS fires, coalesce(dispatches, '') AS dispatches, coalesce(notifies, '') AS notifies, coalesce(views, '') AS views,
       f.a->>'$.file' AS handler_file, CASE WHEN hh.method_id IS NOT NULL THEN 'controller' WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.project_slug = r.project_slug AND e.source = r.route_id AND e.kind = 'routes_to') THEN nullif(action_kind, '') END AS handler_kind,
       coalesce((SELECT string_agg(DISTINCT sname, ',' ORDER BY sname) FROM inc WHERE inc.project_slug = r.project_slug AND inc.kind = 'applies_to' AND inc.target = 'class:' || handler), '') AS policies
FROM routes r LEFT JOIN mw USING (project_slug, route_id) LEFT JOIN hh USING (project_slug, route_id) LEFT JOIN eff USING (project_slug, method_id)
LEFT JOIN n f ON f.project_slug = r.project_slug AND f.id = 'class:' || handler AND f.kind IN ({_KINDS})""",
    "find_handlers": f"""WITH {_N} SELECT r.project_slug, r.route_id, uri, methods, r.name AS route_name, r.action_kind, handler AS class_fqn, handler_method AS method, f.a->>'$.file' AS file, handler_line AS line
FROM routes r LEFT JOIN hh USING (project_slug, route_id) LEFT JOIN n f ON f.project_slug = r.project_slug AND f.id = 'class:' || handler""",
    "find_listeners": f"WITH {_N}, {_LISTENERS} SELECT * FROM lis",
    "find_dispatchers": f"WITH {_N} SELECT project_slug, {_BARE.format('target')} AS event, sa->>'$.class_fqn' AS class_fqn, sname AS method, coalesce(ea->>'$.file', sa->>'$.file') AS file, TRY_CAST(coalesce(ea->>'$.line', sa->>'$.line') AS INT) AS line FROM inc WHERE kind = 'fires'",
    "find_jobs_dispatching": f"WITH {_N} SELECT project_slug, {_BARE.format('target')} AS job, sa->>'$.class_fqn' AS class_fqn, sname AS method, coalesce(ea->>'$.file', sa->>'$.file') AS file, TRY_CAST(coalesce(ea->>'$.line', sa->>'$.line') AS INT) AS line FROM inc WHERE kind = 'dispatches'",
    "get_policy_for": f"""WITH {_N},
f AS (SELECT project_slug, target AS model, arg_min({{'id': source, 'short': sname, 'stated': coalesce(sa->>'$.policy', sa->>'$.fqn'), 'file': sa->>'$.file'}}, edge_seq) AS p FROM inc WHERE kind = 'applies_to' GROUP BY ALL),
m AS (SELECT project_slug, regexp_replace(target, '^(policy|class):', '') AS bare, string_agg(sname, ',' ORDER BY sname) AS methods FROM inc WHERE kind = 'part_of' GROUP BY ALL)
SELECT f.project_slug, model, coalesce(p.stated, regexp_replace(p.id, '^(policy|class):', '')) AS policy_fqn, p.short AS short_name, p.file AS file, coalesce(methods, '') AS methods
FROM f LEFT JOIN m ON m.project_slug = f.project_slug AND m.bare = regexp_replace(p.id, '^(policy|class):', '')""",
    "find_implementations": f"WITH {_N} SELECT project_slug, {_FQN.format('target', 'target')} AS interface, {_FQN.format('source', 'source')} AS fqn, sname AS short_name, sa->>'$.file' AS file, kind AS via FROM inc WHERE kind IN ('implements', 'extends')",
    "find_callers": f"WITH {_N} SELECT project_slug, target AS method_id, sa->>'$.class_fqn' AS class_fqn, sname AS method, coalesce(nullif(ea->>'$.file', ''), sa->>'$.file') AS file, coalesce(nullif(TRY_CAST(ea->>'$.line' AS INT), 0), TRY_CAST(sa->>'$.line' AS INT)) AS line FROM inc WHERE kind = 'calls'",
    "find_cache_users": f"""WITH {_N} SELECT i.project_slug, o.tname AS key, CASE WHEN i.kind = 'cache_read' THEN 'read' ELSE 'write' END AS mode, sa->>'$.class_fqn' AS class_fqn, sname AS method, coalesce(i.ea->>'$.file', sa->>'$.file') AS file,
       coalesce(nullif(TRY_CAST(i.ea->>'$.line' AS INT), 0), TRY_CAST(sa->>'$.line' AS INT)) AS line, i.ea->>'$.form' AS form FROM inc i JOIN out o USING (edge_seq) WHERE i.kind IN ('cache_read', 'cache_write') AND o.tkind = 'cache_key'""",
    "cache_keys_matching": f"WITH {_N} SELECT DISTINCT project_slug, name AS key FROM n WHERE kind = 'cache_key' AND regexp_matches(name, '(?s)^.*\\.list$')",
    "expand_call_tree": _tree("calls", "source", "target", "source"),
    "expand_call_tree_upstream": _tree("calls", "target", "source"),
    "call_tree_limits": f"""WITH {_N}, t AS ({_tree("calls", "source", "target", "source")}),
r AS (SELECT DISTINCT e.project_slug, e.source AS root FROM e JOIN n ON n.project_slug = e.project_slug AND n.id = e.source WHERE e.kind = 'calls'),
v AS (SELECT project_slug, root, id, depth FROM t UNION ALL SELECT project_slug, root, root, 0 FROM r),
m AS (SELECT DISTINCT v.project_slug, v.root FROM v JOIN out o ON o.project_slug = v.project_slug AND o.source = v.id AND o.kind = 'calls'
      WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.project_slug = v.project_slug AND w.root = v.root AND w.id = o.target))
SELECT v.project_slug, v.root, count(*) - 1 AS nodes, CASE WHEN count(*) - 1 >= 200 THEN 'max_nodes' WHEN max(depth) >= 3 AND bool_or(m.root IS NOT NULL) THEN 'max_depth' END AS truncated_reason
FROM v LEFT JOIN m ON m.project_slug = v.project_slug AND m.root = v.root GROUP BY ALL""",
    "bfs": _bfs_sql(5, 200),
    "get_request_flow": f"""WITH {_N}, {_LISTENERS},
f AS (SELECT DISTINCT h.project_slug, h.route_id, {_BARE.format('o.target')} AS event, o.tname AS event_name FROM hh h JOIN out o ON o.project_slug = h.project_slug AND o.source = h.method_id AND o.kind = 'fires'),
l AS (SELECT DISTINCT project_slug, event, listener_id, short_name, listener_fqn, method FROM lis),
c AS (SELECT l.project_slug, l.listener_id, {_effects([('fires', 'fires'), ('dispatches', 'dispatches'), ('notifies', 'notifies')])} FROM (SELECT DISTINCT project_slug, listener_id, listener_fqn, method FROM l) l
      JOIN out ON out.project_slug = l.project_slug AND (out.source = l.listener_id OR out.source = 'method:' || l.listener_fqn || '::' || coalesce(l.method, 'handle')) GROUP BY ALL)
SELECT f.project_slug, f.route_id, f.event_name AS event, l.short_name AS listener, coalesce(fires, '') AS fires, coalesce(dispatches, '') AS dispatches, coalesce(notifies, '') AS notifies
FROM f LEFT JOIN l ON l.project_slug = f.project_slug AND l.event = f.event LEFT JOIN c ON c.project_slug = l.project_slug AND c.listener_id = l.listener_id""",
    "dangling_edges": f"WITH {_N} SELECT e.kind, count(*) AS edges, count(*) FILTER (n.id IS NULL) AS dangling FROM e LEFT JOIN n ON n.project_slug = e.project_slug AND n.id = e.target GROUP BY ALL",
    "find_event_chains": f"""WITH RECURSIVE {_N}, {_LISTENERS},
links AS (SELECT DISTINCT l.project_slug, l.event, l.short_name AS listener, l.listener_fqn, l.listener_id, {_BARE.format('f.target')} AS child FROM lis l LEFT JOIN e f ON f.project_slug = l.project_slug AND f.kind = 'fires'
          AND (f.source = l.listener_id OR f.source = 'method:' || l.listener_fqn || '::' || coalesce(l.method, 'handle'))),
lk AS (SELECT DISTINCT project_slug, event, listener, listener_fqn, child FROM links),
reach AS (SELECT DISTINCT project_slug, event AS root, event, 1 AS depth FROM lk UNION SELECT r.project_slug, r.root, k.child, r.depth + 1 FROM reach r JOIN lk k ON k.project_slug = r.project_slug AND k.event = r.event WHERE k.child IS NOT NULL AND r.depth < 3),
first AS (SELECT project_slug, root, event, min(depth) AS depth FROM reach GROUP BY ALL)
SELECT f.project_slug, f.root, f.depth, f.event AS parent_event, k.listener, k.listener_fqn, k.child AS child_event FROM first f JOIN lk k ON k.project_slug = f.project_slug AND k.event = f.event""",
    "describe_flow": f"""WITH {_N},
r AS (SELECT r.project_slug, route_id, uri, methods, name, handler, handler_method, ltrim(lower(uri), '/') AS u, lower(name) AS nm, lower(handler) AS ha FROM routes r LEFT JOIN hh USING (project_slug, route_id)),
s AS (SELECT *, CAST(contains(hay, 'how') AS INT) + CAST(contains(hay, 'ledger') AS INT) + CAST(contains(hay, 'billing') AS INT) + CAST(contains(hay, 'listed') AS INT) AS sc
      FROM (SELECT *, concat_ws(' ', nullif(u, ''), nullif(nm, ''), nullif(ha, '')) AS hay FROM r)),
q AS (SELECT *, CASE WHEN u = 'how is the ledger of /billing listed' THEN 0 WHEN nm = 'how is the ledger of /billing listed' THEN 1 WHEN sc > 0 THEN 5 END AS k FROM s)
SELECT * FROM (SELECT project_slug, row_number() OVER (PARTITION BY project_slug ORDER BY k, sc DESC, uri, route_id) AS position, route_id, uri, methods, name, handler AS handler_fqn, handler_method, 'token_overlap' AS match_quality, greatest(sc, 1) AS score,
       count(*) OVER (PARTITION BY project_slug) = 1 AS winner FROM q WHERE k IS NOT NULL) WHERE position <= 10""",
}
