"""One question at a time: named queries with checked arguments, error codes, trimming, timing and a trace, and free-text questions.

Each query here is the batch query of ``tools`` narrowed to its subject, so the filter reaches the scans. Errors are codes in the
response, not exceptions.
"""

from __future__ import annotations

import inspect
import time
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import retrieval, text
from graphloom.plans import responses, router, tools


class QueryError(ValueError):
    """An expected failure; the message is the error code."""


def resolve_method(g: G.Graph, query: str) -> DataFrame:
    """(project_slug, id): the method named by its id, by ``Class::method``, or by the class and name it states; the best kind of match per project."""
    stated = F.concat_ws("::", "a.class_fqn", "name") == query
    rank = F.when(F.col("id") == query, 0).when(F.col("id") == f"method:{query}", 1).when(stated, 2)
    rows = g.of_kind("method").select("project_slug", "id", rank.alias("rank")).where("rank IS NOT NULL")
    return rows.groupBy("project_slug").agg(F.min(F.struct("rank", "id")).alias("r")).select("project_slug", "r.id")


def resolve_event(g: G.Graph, query: str) -> DataFrame:
    """(project_slug, event): the bare name of the event meant by an id of either form, a class of kind event, or a node's name."""
    bare = query.removeprefix("event:").removeprefix("class:")
    own = g.of_kind("event").select("project_slug", G.bare_event(F.col("id")).alias("event"), "name")
    rank = F.when(F.col("event") == bare, 0).when(F.col("name") == bare, 1)
    rows = own.withColumn("rank", rank).where("rank IS NOT NULL")
    return rows.groupBy("project_slug").agg(F.min(F.struct("rank", "event")).alias("r")).select("project_slug", "r.event")


class Engine:
    """The graph with its chunks, vectors and files, and the queries on them by name."""

    def __init__(self, spark: SparkSession, graph: G.Graph, chunks: DataFrame | None = None, vectors: DataFrame | None = None, embedder=None, files: DataFrame | None = None, calls_indexed: bool = True, max_items: int = responses.MAX_ITEMS):
        self.spark, self.graph, self.chunks, self.vectors, self.embedder, self.files = spark, graph, chunks, vectors, embedder, files
        self.calls_indexed, self.max_items = calls_indexed, max_items
        self.traces: list[dict] = []

    def for_project(self, slug: str) -> Engine:
        only = lambda df: None if df is None else df.where(F.col("project_slug") == slug)
        graph = replace(self.graph, nodes=only(self.graph.nodes), edges=only(self.graph.edges))
        return Engine(self.spark, graph, only(self.chunks), only(self.vectors), self.embedder, self.files, self.calls_indexed, self.max_items)

    @property
    def names(self) -> list[str]:
        return sorted(n.removeprefix("tool_") for n in dir(self) if n.startswith("tool_"))

    def run(self, name: str, /, **args) -> DataFrame:
        """The rows of a query; raises QueryError with its code."""
        method: Callable | None = getattr(self, f"tool_{name}", None)
        if method is None:
            raise QueryError("tool_not_found")
        try:
            inspect.signature(method).bind(**args)
        except TypeError as e:
            raise QueryError("invalid_input") from e
        try:
            return method(**args)
        except QueryError:
            raise
        except ValueError as e:
            raise QueryError(str(e).split(":")[0]) from e

    def query(self, name: str, /, **args) -> responses.Response:
        """The rows, trimmed, with counts or an error code; a trace record is kept."""
        began, trace = time.perf_counter(), {"trace_id": uuid.uuid4().hex[:12], "schema_version": 1, "kind": "tool_executed", "tool": name}
        try:
            df = self.run(name, **args)
            order = [c for c in ("project_slug", "position", "rank", "depth", "uri", "fqn", "class_fqn", "method", "line", *df.columns) if c in df.columns]
            response = responses.trim(df, list(dict.fromkeys(order)), self.max_items)
        except QueryError as e:
            response = responses.Response(self.spark.createDataFrame([], "project_slug string"), 0, 0, error_code=str(e))
        self.traces.append(trace | {"duration_ms": round((time.perf_counter() - began) * 1000, 1), "error_code": response.error_code})
        return response

    def ask(self, question: str, floor: float = router.FLOOR) -> router.Answer:
        callables = {n: (lambda a, n=n: self.run(n, **{k: v for k, v in a.items() if k})) for n in self.names}
        answer = router.ask(self.spark, question, callables, floor)
        self.traces.append({"trace_id": uuid.uuid4().hex[:12], "schema_version": 1, "kind": "ask_refusal" if answer.result is None else "ask_envelope", "query": question, "tool": answer.tool, "confidence": answer.confidence})
        return answer

    # --- helpers ------------------------------------------------------------------------------------------------------

    def _some(self, df: DataFrame, code: str) -> DataFrame:
        if not df.limit(1).count():
            raise QueryError(code)
        return df

    def _class(self, fqn: str) -> DataFrame:
        asked = self.graph.nodes.select("project_slug").distinct().withColumn("fqn", F.lit(fqn.removeprefix("class:")))
        return self._some(G.resolve_class(self.graph, asked), "class_not_found").select("project_slug", F.col("node_id").alias("class_id"))

    def _event(self, event: str) -> DataFrame:
        return self._some(resolve_event(self.graph, event), "event_not_found")

    def _method(self, method_fqn: str) -> DataFrame:
        return self._some(resolve_method(self.graph, method_fqn), "method_not_found")

    def _route(self, df: DataFrame, route_id: str | None, method: str | None, uri: str | None) -> DataFrame:
        """The rows of one route per project: by id, or the first by id with the uri and verb."""
        routes = self.graph.of_kind("route").select("project_slug", F.col("id").alias("route_id"), tools._uri(F.col("name")).alias("u"), F.col("a.methods").alias("v"))
        if route_id:
            routes = routes.where(F.col("route_id") == route_id)
        elif uri:
            routes = routes.where(F.col("u") == uri)
            routes = routes.where(F.array_contains("v", method.upper())) if method else routes
        else:
            raise QueryError("invalid_input")
        first = self._some(routes, "route_not_found").groupBy("project_slug").agg(F.min("route_id").alias("route_id"))
        return df.join(first, ["project_slug", "route_id"], "left_semi")

    # --- the queries --------------------------------------------------------------------------------------------------

    def tool_list_routes(self, method: str | None = None, uri_glob: str | None = None, name_glob: str | None = None, middleware: str | None = None) -> DataFrame:
        return tools.list_routes(self.graph, method, uri_glob, name_glob, middleware)

    def tool_list_scheduled_tasks(self, target_glob: str | None = None, expression_glob: str | None = None) -> DataFrame:
        return tools.list_scheduled_tasks(self.graph, target_glob, expression_glob)

    def tool_list_by_kind(self, kind: str, name_glob: str | None = None, namespace_prefix: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
        return tools.list_by_kind(self.graph, kind, name_glob, namespace_prefix, offset, limit)

    def tool_list_modules(self, min_classes: int = 2) -> DataFrame:
        return tools.list_modules(self.graph, min_classes)

    def tool_describe_module(self, prefix: str, sample_per_kind: int = 5) -> DataFrame:
        return self._some(tools.describe_module(self.graph, prefix, sample_per_kind), "empty_module")

    def tool_explore_entity(self, name: str, max_per_kind: int = 10) -> DataFrame:
        return self._some(tools.explore_entity(self.graph, name, max_per_kind), "no_matches")

    def tool_describe_class(self, fqn: str) -> DataFrame:
        return tools.describe_class(self.graph).join(self._class(fqn.split("::")[0]), ["project_slug", "class_id"], "left_semi")

    def tool_get_model_context(self, fqn: str) -> DataFrame:
        return tools.get_model_context(self.graph).join(self._class(fqn).withColumnRenamed("class_id", "model"), ["project_slug", "model"], "left_semi")

    def tool_trace_route(self, route_id: str | None = None, method: str | None = None, uri: str | None = None) -> DataFrame:
        return self._route(tools.trace_route(self.graph), route_id, method, uri)

    def tool_get_request_flow(self, route_id: str | None = None, method: str | None = None, uri: str | None = None) -> DataFrame:
        return self._route(tools.get_request_flow(self.graph), route_id, method, uri)

    def tool_describe_flow(self, query: str, max_candidates: int = 10) -> DataFrame:
        return self._some(tools.describe_flow(self.graph, query, max_candidates), "no_matches")

    def tool_find_handlers(self, uri_glob: str | None = None, method: str | None = None, handler_fqn: str | None = None) -> DataFrame:
        if uri_glob is None and handler_fqn is None:
            raise QueryError("missing_filter")
        return tools.find_handlers(self.graph, uri_glob, method, handler_fqn)

    def tool_find_listeners(self, event: str) -> DataFrame:
        return tools.listeners(self.graph).join(self._event(event), ["project_slug", "event"], "left_semi")

    def tool_find_dispatchers(self, event: str) -> DataFrame:
        return tools.find_dispatchers(self.graph).join(self._event(event), ["project_slug", "event"], "left_semi")

    def tool_find_event_chains(self, event: str, max_depth: int = 3) -> DataFrame:
        return tools.find_event_chains(self.graph, max_depth).join(self._event(event).withColumnRenamed("event", "root"), ["project_slug", "root"], "left_semi")

    def tool_find_jobs_dispatching(self, job: str) -> DataFrame:
        bare = job.removeprefix("job:").removeprefix("class:")
        known = self.graph.of_kind("job").where((F.regexp_replace("id", "^(job|class):", "") == bare) | (F.col("name") == bare))
        found = self._some(known, "job_not_found").select("project_slug", F.regexp_replace("id", "^(job|class):", "").alias("job"))
        sites = tools.find_jobs_dispatching(self.graph).withColumn("job", F.regexp_replace("job", "^job:", ""))
        return sites.join(found, ["project_slug", "job"], "left_semi")

    def tool_get_policy_for(self, model_fqn: str) -> DataFrame:
        try:
            model = self._class(model_fqn).withColumnRenamed("class_id", "model")
        except QueryError as e:
            raise QueryError("model_not_found") from e
        return self._some(tools.get_policy_for(self.graph).join(model, ["project_slug", "model"], "left_semi"), "policy_not_found")

    def tool_resolve_binding(self, abstract: str) -> DataFrame:
        return self._some(tools.resolve_binding(self.graph).where(F.col("abstract") == abstract.removeprefix("binding:")), "binding_not_found")

    def tool_find_implementations(self, interface_fqn: str, include_subclasses: bool = True) -> DataFrame:
        own = self._class(interface_fqn).select("project_slug", G.class_fqn(F.col("class_id")).alias("interface"))
        return tools.find_implementations(self.graph, include_subclasses).join(own, ["project_slug", "interface"], "left_semi")

    def tool_find_callers(self, method_fqn: str) -> DataFrame:
        rows = tools.find_callers(self.graph).join(self._method(method_fqn).withColumnRenamed("id", "method_id"), ["project_slug", "method_id"], "left_semi")
        return rows if self.calls_indexed else self._some(rows, "calls_not_indexed")

    def tool_expand_call_tree(self, method_fqn: str, direction: str = "downstream", max_depth: int = 3, max_nodes: int = 200) -> DataFrame:
        if direction not in ("downstream", "upstream"):
            raise QueryError("invalid_direction")
        root = self._method(method_fqn).withColumnRenamed("id", "root")
        if not self.calls_indexed:
            raise QueryError("calls_not_indexed")
        return tools.expand_call_tree(self.graph, root, direction, max_depth, max_nodes)

    def tool_find_cache_users(self, key: str, mode: str = "any") -> DataFrame:
        if mode not in ("any", "read", "write"):
            raise QueryError("invalid_mode")
        return tools.find_cache_users(self.graph, mode).join(self._some(tools.cache_keys_matching(self.graph, key), "key_not_found"), ["project_slug", "key"], "left_semi")

    def tool_semantic_search(self, query: str, top_k: int = 30, final_k: int = 10, min_vector_score: float = 0.4) -> DataFrame:
        if self.embedder is None or self.vectors is None:
            raise QueryError("no_embedder")
        vector = [float(x) for x in self.embedder.embed([query])[0]]
        ours = retrieval.latest_vectors(self.vectors.where((F.col("embedder_id") == self.embedder.model_id) & (F.size("vector") == len(vector))))
        asked = ours.select("project_slug", "embedder_id").distinct().select("project_slug", "embedder_id", F.lit("query").alias("id"), F.array(*[F.lit(x) for x in vector]).cast("array<float>").alias("vector"))
        hits = retrieval.semantic_search(self.graph, ours, asked, top_k, final_k, min_vector_score)
        return self._some(retrieval.annotate_hits(self.graph, hits), "low_relevance")

    def tool_get_full_block(self, file_path: str, start_line: int, end_line: int, context_lines: int = 0) -> DataFrame:
        files = self.files if self.files is not None else self.spark.createDataFrame([], "file_path string, text string, mtime timestamp")
        ask = self.spark.createDataFrame([(file_path, start_line, end_line, min(context_lines, 20), None)], "file_path string, start_line int, end_line int, context_lines int, indexed_at timestamp")
        rows = text.read_block(files.where(F.col("file_path") == file_path), ask)
        if code := rows.first()["error_code"]:
            raise QueryError(code)
        return rows

    def tool_get_node_body(self, node_id: str) -> DataFrame:
        self._some(self.graph.nodes.where(F.col("id") == node_id), "node_not_found")
        if self.chunks is None:
            raise QueryError("chunk_not_found")
        return self._some(text.node_bodies(self.graph, self.chunks).where(F.col("node_id") == node_id), "chunk_not_found")
