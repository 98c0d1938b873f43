"""Routing, coverage, traces and profile queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import profiles
from graphloom.plans import responses, router
from graphloom.session import table
from graphloom.sources import stores


def route_questions(spark: SparkSession, d: str) -> DataFrame:
    """Every question of the ask log, in whatever spelling the source comes."""
    docs = table(spark, d, "documents").where(F.regexp_replace(F.lower(F.trim("source")), "[ _-]+", "_") == "ask_log")
    return router.route(docs.select("doc_id", F.col("text").alias("query"))).drop("query")


def index_coverage(spark: SparkSession, d: str) -> DataFrame:
    return responses.coverage(table(spark, d, "project_meta"))


def trace_outcomes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lower(trim(source)) = 'trace'")
    return stores.trace_summary(stores.trace_records(docs))


def profile_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores from the files chunks come from; every project is taken to require the framework."""
    files = table(spark, d, "chunks").select("project_slug", F.regexp_replace("file_path", "^src/App/", "app/").alias("path")).distinct()
    packages = files.select("project_slug", F.lit("laravel/framework").alias("package")).distinct()
    return profiles.profile_scores(files, packages)


QUERIES = {f.__name__: f for f in (route_questions, index_coverage, trace_outcomes, profile_scores)}



def _signal_sql(s: profiles.Signal) -> str:
    if s.kind == "path_exists":
        return "count(*) FILTER (regexp_matches(path, '^" + s.value.replace(".", "\\.").replace("*", "[^/]*") + "(/|$)'))"
    if s.kind == "class_suffix_frequency":
        return f"count(*) FILTER (starts_with(path, 'app/') AND ends_with(path, '{s.value}.php'))"
    return "1" if s.value == "laravel/framework" else "0"


def _profile_sql(name: str, signals: list[profiles.Signal]) -> str:
    fired = " + ".join(f"CASE WHEN {_signal_sql(s)} >= {s.threshold} THEN {s.weight} ELSE 0 END" for s in signals)
    return f"SELECT project_slug, '{name}' AS profile, ({fired}) / {float(sum(s.weight for s in signals))} * 100 AS score FROM f GROUP BY 1"


_ROUTING = r"""
WITH docs AS (
  SELECT doc_id, regexp_replace(trim(coalesce(text, '')), '[\r\n]+', ' ', 'g') AS q
  FROM documents WHERE regexp_replace(lower(trim(source)), '[ _-]+', '_', 'g') = 'ask_log'),
split AS (
  SELECT *, list_transform(regexp_split_to_array(q, '\s+'), lambda w: regexp_replace(w, '[\s?!.,;:''"`)\]]+$', '')) AS w FROM docs),
words AS (SELECT *, ' ' || q || ' ' AS p, list_transform(w, lambda x: lower(x)) AS l, list_filter(w, lambda x: regexp_matches(x, '^[A-Z]\w*(\\[A-Z]\w*)+(::[A-Za-z_]\w*)?$'))[1] AS cls FROM split),
caught AS (
  SELECT *,
    coalesce(nullif(regexp_extract(p, '(?i)\s(?:listen(?:s|ing)?|subscribes?)\s+(?:to|for)\s+(\S+)', 1), ''),
             nullif(regexp_extract(p, '(?i)\s(?:listeners?|subscribers)\s+(?:for|of|to|handle|handling)\s+(\S+)', 1), ''),
             nullif(regexp_extract(p, '(?i)\s(?:handles?|handling)\s+(?:the\s+)?(\S+)\s+event(?:\W)', 1), '')) AS listened,
    coalesce(nullif(regexp_extract(p, '(?i)\sflow\s+(?:for|of)\s+(?:get|post|put|patch|delete|head|options)\s+(/\S*)', 1), ''),
             nullif(regexp_extract(p, '(?i)\sflow\s+(?:for|of)\s+(/\S*)', 1), '')) AS flowed,
    nullif(upper(regexp_extract(p, '(?i)\sflow\s+(?:for|of)\s+(get|post|put|patch|delete|head|options)\s+/', 1)), '') AS flow_verb,
    coalesce(nullif(regexp_extract(p, '(?i)\s(?:what|who|which|controller|action|method)\s+(?:handles|serves|answers)\s+(?:the\s+)?(\S.*)$', 1), ''),
             nullif(regexp_extract(p, '(?i)\shandlers?\s+(?:for|of)\s+(?:the\s+)?(\S.*)$', 1), '')) AS handled,
    nullif(regexp_extract(p, '(?i)\s(?:get|post|put|patch|delete|head|options)\s+(/\S*)', 1), '') AS traced,
    nullif(upper(regexp_extract(p, '(?i)\s(get|post|put|patch|delete|head|options)\s+/', 1)), '') AS trace_verb,
    coalesce(nullif(regexp_extract(p, '(?i)\s(?:dispatch(?:es)?|queues?|enqueues)\s+(?:the\s+)?(\S*job)\W', 1), ''),
             nullif(regexp_extract(p, '(?i)\s(\S*job)\s+(?:(?:is|gets)\s+)?(?:dispatched|queued|enqueued)\W', 1), '')) AS queued,
    coalesce(nullif(regexp_extract(p, '(?i)\s(?:dispatches|fires|triggers|emits|raises)\s+(?:the\s+)?(\S+)', 1), ''),
             nullif(regexp_extract(p, '(?i)\s(?:dispatchers?|emitters)\s+(?:of|for)\s+(\S+)', 1), ''),
             nullif(regexp_extract(p, '(?i)\swhere\s+(?:is|does|gets)\s+(\S+)\s+(?:dispatched|fired|emitted|raised|triggered)\W', 1), ''),
             nullif(regexp_extract(p, '(?i)\swhere\s+(\S+)\s+(?:(?:is|gets)\s+)?(?:dispatched|fired|emitted|raised|triggered)\W', 1), '')) AS fired,
    coalesce(nullif(regexp_extract(p, '(?i)\s(?:who|what|which|class|classes)\s+implements?\s+(\S+)', 1), ''),
             nullif(regexp_extract(p, '(?i)\s(?:implementations?|implementers|implementors)\s+of\s+(\S+)', 1), '')) AS implemented,
    coalesce(nullif(regexp_extract(p, '(?i)\s(?:calls?|invokes|uses)\s+(\S+::\S+)', 1), ''),
             nullif(regexp_extract(p, '(?i)\scallers?\s+of\s+(\S+::\S+)', 1), '')) AS called,
    coalesce(nullif(regexp_extract(p, '(?i)\s(?:policy|policies|authori[sz]ation|permissions)\s+(?:for|of|on)\s+(?:the\s+)?(\S+)', 1), ''),
             nullif(regexp_extract(p, '(?i)\s(?:authori[sz]es|guards)\s+(\S+)', 1), '')) AS guarded,
    coalesce(nullif(regexp_extract(p, '(?i)\s(?:bound|bindings?)\s+(?:to|for|of)\s+(\S+)', 1), ''),
             nullif(regexp_extract(p, '(?i)\s(?:resolves?|provides)\s+(\S+)', 1), ''),
             nullif(regexp_extract(p, '(?i)\scontainer\s+(?:gives?|returns?)\s+for\s+(\S+)', 1), '')) AS bound,
    coalesce(nullif(regexp_extract(p, '(?i)\show\s+(?:does|do|is|are)\s+(\S.*)$', 1), ''),
             nullif(regexp_extract(p, '(?i)\s(?:walk|take|lead)\s+me\s+through\s+(?:the\s+)?(\S.*)$', 1), ''),
             nullif(regexp_extract(p, '(?i)\swhat\s+happens\s+(?:when|if|on|after|during|once)\s+(?:the\s+)?(\S.*)$', 1), ''),
             nullif(regexp_extract(p, '(?i)\s(?:flow|process)\s+(?:of|for|behind)\s+(?:the\s+)?(\S.*)$', 1), '')) AS described,
    coalesce(nullif(regexp_extract(p, '(?i)\s(?:explain|describe|explore)\s+(?:the\s+)?(\S.*)$', 1), ''),
             nullif(regexp_extract(p, '(?i)\stell\s+me\s+about\s+(?:the\s+)?(\S.*)$', 1), ''),
             nullif(regexp_extract(p, '(?i)\s(?:what|who)\s+(?:is|are)\s+(?:the\s+)?(\S.*)$', 1), ''),
             nullif(regexp_extract(p, '(?i)\sshow\s+me\s+(?:the\s+)?(\S.*)$', 1), ''),
             nullif(regexp_extract(p, '(?i)\sshow\s+(?:the\s+)?(\S.*)$', 1), '')) AS explored,
    CASE WHEN l[1] IN ('list', 'show', 'what', 'which') THEN regexp_replace(array_to_string(list_filter(l[2:], lambda x: x NOT IN ('all', 'the', 'every', 'some', 'me', 'us', 'my', 'our', 'available', 'are', 'there', 'exist', 'do', 'we', 'have')), ' '), '[-_]', ' ', 'g') END AS noun
  FROM words),
bare AS (
  SELECT * REPLACE (
    nullif(regexp_replace(listened, '[\s?!.,;:''"`)\]]+$', ''), '') AS listened, nullif(regexp_replace(flowed, '[\s?!.,;:''"`)\]]+$', ''), '') AS flowed,
    nullif(regexp_replace(handled, '[\s?!.,;:''"`)\]]+$', ''), '') AS handled, nullif(regexp_replace(traced, '[\s?!.,;:''"`)\]]+$', ''), '') AS traced,
    nullif(regexp_replace(queued, '[\s?!.,;:''"`)\]]+$', ''), '') AS queued, nullif(regexp_replace(fired, '[\s?!.,;:''"`)\]]+$', ''), '') AS fired,
    nullif(regexp_replace(implemented, '[\s?!.,;:''"`)\]]+$', ''), '') AS implemented, nullif(regexp_replace(called, '[\s?!.,;:''"`)\]]+$', ''), '') AS called,
    nullif(regexp_replace(guarded, '[\s?!.,;:''"`)\]]+$', ''), '') AS guarded, nullif(regexp_replace(bound, '[\s?!.,;:''"`)\]]+$', ''), '') AS bound,
    nullif(regexp_replace(described, '[\s?!.,;:''"`)\]]+$', ''), '') AS described, nullif(regexp_replace(explored, '[\s?!.,;:''"`)\]]+$', ''), '') AS explored)
  FROM caught),
named AS (
  SELECT * REPLACE (
    CASE WHEN list_contains(regexp_split_to_array(lower(handled), '\s+'), 'event') THEN NULL
         ELSE regexp_replace(regexp_replace(regexp_replace(handled, '(?i)^(get|post|put|patch|delete|head|options)\s+(\S)', '\2'), '(?i)(\S)\s+(routes?|endpoints?)$', '\1'), '\s+', ' ', 'g') END AS handled,
    regexp_replace(regexp_replace(described, '(?i)(\S)\s+(works?|happens?|function|run|flow|process)$', '\1'), '\s+', ' ', 'g') AS described,
    regexp_replace(regexp_replace(explored, '(?i)(\S)\s+(entity|class|model|service|controller|aggregate|command|handler|event|listener|job|notification|policy|enum|interface)$', '\1'), '\s+', ' ', 'g') AS explored),
    CASE WHEN noun IN ('event', 'events', 'job', 'jobs', 'notification', 'notifications', 'listener', 'listeners', 'observer', 'observers', 'model', 'models', 'controller', 'controllers',
                       'mailable', 'mailables', 'resource', 'resources', 'command', 'commands', 'cast', 'casts') THEN regexp_replace(noun, 's$', '')
         WHEN noun IN ('form request', 'form requests') THEN 'form_request' WHEN noun IN ('service provider', 'service providers') THEN 'service_provider'
         WHEN noun IN ('policy', 'policies') THEN 'policy' WHEN noun IN ('class', 'classes') THEN 'class' END AS kind
  FROM bare)
SELECT doc_id, r.tool, r.arg_name, r.arg, r.method, CAST(r.confidence AS DOUBLE) AS confidence, r.fallbacks
FROM (SELECT doc_id, CASE
  WHEN listened IS NOT NULL THEN {'tool': 'find_listeners', 'arg_name': 'event', 'arg': listened, 'method': NULL, 'confidence': 0.85, 'fallbacks': 'semantic_search'}
  WHEN flowed IS NOT NULL THEN {'tool': 'get_request_flow', 'arg_name': 'uri', 'arg': flowed, 'method': flow_verb, 'confidence': 0.85, 'fallbacks': 'semantic_search'}
  WHEN handled IS NOT NULL THEN {'tool': 'find_handlers', 'arg_name': 'uri_glob', 'arg': CASE WHEN starts_with(handled, '/') THEN handled ELSE '*' || handled || '*' END, 'method': NULL, 'confidence': 0.85, 'fallbacks': 'semantic_search'}
  WHEN traced IS NOT NULL THEN {'tool': 'trace_route', 'arg_name': 'uri', 'arg': traced, 'method': trace_verb, 'confidence': 0.95, 'fallbacks': 'get_request_flow,semantic_search'}
  WHEN queued IS NOT NULL THEN {'tool': 'find_jobs_dispatching', 'arg_name': 'job', 'arg': queued, 'method': NULL, 'confidence': 0.85, 'fallbacks': 'semantic_search'}
  WHEN fired IS NOT NULL THEN {'tool': 'find_dispatchers', 'arg_name': 'event', 'arg': fired, 'method': NULL, 'confidence': 0.8, 'fallbacks': 'semantic_search'}
  WHEN implemented IS NOT NULL THEN {'tool': 'find_implementations', 'arg_name': 'interface_fqn', 'arg': implemented, 'method': NULL, 'confidence': 0.85, 'fallbacks': 'semantic_search'}
  WHEN called IS NOT NULL THEN {'tool': 'find_callers', 'arg_name': 'method_fqn', 'arg': called, 'method': NULL, 'confidence': 0.85, 'fallbacks': 'semantic_search'}
  WHEN guarded IS NOT NULL THEN {'tool': 'get_policy_for', 'arg_name': 'model_fqn', 'arg': guarded, 'method': NULL, 'confidence': 0.8, 'fallbacks': 'semantic_search'}
  WHEN bound IS NOT NULL THEN {'tool': 'resolve_binding', 'arg_name': 'abstract', 'arg': bound, 'method': NULL, 'confidence': 0.75, 'fallbacks': 'semantic_search'}
  WHEN regexp_matches(lower(cls), '\\models?(\\|$)') OR regexp_matches(lower(cls), '^models?\\') THEN {'tool': 'get_model_context', 'arg_name': 'fqn', 'arg': cls, 'method': NULL, 'confidence': 0.85, 'fallbacks': 'describe_class,semantic_search'}
  WHEN cls IS NOT NULL THEN {'tool': 'describe_class', 'arg_name': 'fqn', 'arg': cls, 'method': NULL, 'confidence': 0.8, 'fallbacks': 'semantic_search'}
  WHEN l[1] IN ('list', 'show', 'what', 'which') AND list_contains(l, 'routes') THEN {'tool': 'list_routes', 'arg_name': '', 'arg': '', 'method': NULL, 'confidence': 0.9, 'fallbacks': ''}
  WHEN kind IS NOT NULL THEN {'tool': 'list_by_kind', 'arg_name': 'kind', 'arg': kind, 'method': NULL, 'confidence': 0.85, 'fallbacks': ''}
  WHEN described <> '' THEN {'tool': 'describe_flow', 'arg_name': 'query', 'arg': described, 'method': NULL, 'confidence': 0.75, 'fallbacks': 'semantic_search'}
  WHEN explored NOT LIKE '% %' AND length(explored) >= 3 THEN {'tool': 'explore_entity', 'arg_name': 'name', 'arg': explored, 'method': NULL, 'confidence': 0.8, 'fallbacks': 'semantic_search'}
  ELSE {'tool': 'semantic_search', 'arg_name': 'query', 'arg': q, 'method': NULL, 'confidence': 0.4, 'fallbacks': ''} END AS r FROM named)"""

ORACLE = {
    "profile_scores": f"""
WITH f AS (SELECT DISTINCT project_slug, regexp_replace(file_path, '^src/App/', 'app/') AS path FROM chunks),
s AS ({' UNION ALL '.join(_profile_sql(n, ss) for n, ss in profiles.PROFILES.items())})
SELECT *, row_number() OVER (PARTITION BY project_slug ORDER BY score DESC, profile) AS position FROM s""",
    "route_questions": _ROUTING,
    "trace_outcomes": """
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lower(trim(source)) = 'trace' AND text IS NOT NULL),
r AS (SELECT line->>'$.trace_id' AS trace_id, line->>'$.kind' AS kind, line->>'$.query' AS query, TRY_CAST(line->>'$.duration_ms' AS DOUBLE) AS ms FROM (SELECT CASE WHEN starts_with(trim(line), '{') AND json_valid(line) THEN line END AS line FROM l) WHERE line IS NOT NULL)
SELECT trace_id, string_agg(DISTINCT query, '; ' ORDER BY query) AS queries, count(*) FILTER (kind = 'tool_executed') AS tool_calls, coalesce(sum(ms), 0) AS duration_ms, CASE WHEN bool_or(kind = 'ask_refusal') THEN 'refused' ELSE 'answered' END AS outcome FROM r GROUP BY 1""",
    "index_coverage": """SELECT project_slug, m.lsp_server IS NOT NULL AS calls_indexed, m.embedder_id AS embedder_id, m.indexed_at AS indexed_at
FROM (SELECT project_slug, max_by({'lsp_server': lsp_server, 'embedder_id': embedder_id, 'indexed_at': indexed_at}, (started_at, run_id)) AS m FROM project_meta WHERE run_status = 'ok' GROUP BY 1)""",
}
