"""Text and retrieval queries over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import retrieval, text
from graphloom.session import table, written


def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows: the 10 nearest."""
    rows = table(spark, d, "embeddings").select(F.lit("all").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found = retrieval.block_top_k(rows, rows.where("id % 20 = 0"), 10)
    return found.select("qid", "id", "score", "rank")


def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors whose id, read as a number, is divisible by 20 as queries, against all of their project and embedder."""
    vectors = written(retrieval.latest_vectors(table(spark, d, "vectors")))
    head, tail = (F.conv(x, 16, 10).cast("long") for x in (F.substr("id", F.lit(1), F.lit(10)), F.substr("id", F.lit(11))))  # 16^6 leaves 16
    queries = vectors.where((head % 20 * 16 + tail) % 20 == 0)
    return retrieval.semantic_search(G.load_graph(spark, d), vectors, queries)


def search_annotations(spark: SparkSession, d: str) -> DataFrame:
    hits = semantic_search(spark, d).where("kind = 'method'").select("project_slug", "node_id").distinct()
    return retrieval.annotate_hits(G.load_graph(spark, d), hits)


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return text.paragraphs(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "piece_no", "start_line", "end_line", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def get_node_body(spark: SparkSession, d: str) -> DataFrame:
    rows = text.node_bodies(G.load_graph(spark, d), table(spark, d, "chunks"))
    return rows.select("project_slug", "node_id", "kind", "symbol", "container_class", "file", "start_line", "end_line", "chunk_id", F.sha2("content", 256).alias("digest"))


def get_full_block(spark: SparkSession, d: str) -> DataFrame:
    """Lines 2 to 4 with one line of context of every document, read as a file."""
    docs = table(spark, d, "documents")
    files = docs.select(F.col("doc_id").cast("string").alias("file_path"), "text", F.col("captured_at").cast("timestamp").alias("mtime"))
    asks = docs.select(F.col("doc_id").cast("string").alias("file_path"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"), F.lit(1).alias("context_lines"), F.lit("2025-06-01 00:00:00").cast("timestamp").alias("indexed_at"))
    rows = text.read_block(files, asks)
    return rows.select("file_path", "start_line", "end_line", "line_count", "total_file_lines", F.sha2("content", 256).alias("digest"), "truncated_to_eof", "stale", "error_code")


def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The snippet of a hit in lines 4 to 50 of every document, read as a file."""
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text")
    hits = files.select("file_path", F.lit(4).alias("start_line"), F.lit(50).alias("end_line"))
    return text.snippets(hits, files).select("file_path", F.length("snippet").alias("length"), F.sha2("snippet", 256).alias("digest"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = text.latest_chunks(table(spark, d, "chunks"))
    return c.select("id", text.chunk_id(F.col("file_path"), F.col("start_byte"), F.col("end_byte")).alias("computed"), text.estimated_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), (F.col("end_byte") - F.col("start_byte")).alias("byte_length"), (F.col("end_line") - F.col("start_line") + 1).alias("line_count"))


def enriched_chunks(spark: SparkSession, d: str) -> DataFrame:
    return text.enrich_chunks(G.load_graph(spark, d), table(spark, d, "chunks"))


def source_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The latest text of every chunk, chunked again as a source file of its own."""
    c = text.latest_chunks(table(spark, d, "chunks")).select(F.col("id").alias("file_path"), "text")
    return text.chunk_sources(c).select("file_path", "id", "kind", "symbol", "start_byte", "end_byte", "start_line", "end_line")


def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts to embed against all texts: what the cache saves."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(text.cache_key(F.lit("hashing-v1"), F.col("text")).alias("key"))
    return docs.groupBy("key").agg(F.count("*").alias("uses"))


def embedded_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    cache = spark.createDataFrame([], "key string, vector array<float>")
    return text.embed_missing(docs, cache, text.HashingEmbedder())[0]


def orphan_vectors(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.orphans(table(spark, d, "vectors"), table(spark, d, "chunks").where("text IS NOT NULL AND text <> ''"), ["id"])


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Vectors embedded from May 2025 on put over the earlier ones."""
    v = table(spark, d, "vectors").select("embedder_id", "id", "embedded_at", F.size("vector").alias("dim")).where("embedder_id IS NOT NULL")
    new = v.where("embedded_at >= '2025-05-01'").dropDuplicates()
    old = v.where("embedded_at < '2025-05-01'").groupBy("embedder_id", "id").agg(F.max("embedded_at").alias("embedded_at"), F.max("dim").alias("dim"))
    return retrieval.upsert(old, new, ["embedder_id", "id"], "embedded_at").select("embedder_id", "id", "embedded_at")


def embedding_cost(spark: SparkSession, d: str) -> DataFrame:
    return text.embedding_cost(table(spark, d, "chunks").where("text IS NOT NULL").select(F.octet_length("text").alias("n")), "n", 0.02)


QUERIES = {f.__name__: f for f in (vector_top_k, semantic_search, search_annotations, chunk_documents, get_node_body, get_full_block, search_snippets, chunk_ids, enriched_chunks, source_chunks, embedding_cache, embedded_documents, orphan_vectors, vector_upsert, embedding_cost)}

_N = "n AS (SELECT project_slug, id, kind, name, attributes AS a FROM (SELECT *, row_number() OVER (PARTITION BY project_slug, id ORDER BY kind NULLS FIRST, name NULLS FIRST, attributes NULLS FIRST) AS r FROM nodes) WHERE r = 1)"
_WEIGHT = "CASE WHEN n.kind IS NULL THEN 0.9 " + " ".join(f"WHEN n.kind = '{k}' THEN {w}" for k, w in retrieval.KIND_WEIGHTS.items()) + " ELSE 1.0 END"

ORACLE = {
    "search_snippets": """
WITH l AS (SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n') END AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(l[2:31], chr(10)) END AS s FROM l)
SELECT CAST(doc_id AS VARCHAR) AS file_path, length(s)::INT AS length, sha256(s) AS digest FROM s""",
    "vector_top_k": """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
p AS (SELECT q.id AS qid, v.id, round(list_cosine_similarity(q.vec, v.vec), 6) AS score FROM v q, v WHERE q.id % 20 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 10""",
    "semantic_search": f"""
WITH {_N},
ok AS (SELECT *, CAST(vector AS DOUBLE[]) AS vec FROM vectors WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY embedder_id, id ORDER BY embedded_at DESC NULLS LAST) AS r FROM ok) WHERE r = 1),
p AS (SELECT q.project_slug, q.embedder_id, q.id AS qid, v.id, round(list_cosine_similarity(q.vec, v.vec), 6) AS s, coalesce(nullif(v.payload.node_id, ''), 'chunk:' || v.id) AS node_id
      FROM v q JOIN v ON v.project_slug = q.project_slug AND v.embedder_id = q.embedder_id AND len(v.vec) = len(q.vec) WHERE (CAST('0x' || substr(q.id, 1, 8) AS BIGINT) * 256 + CAST('0x' || substr(q.id, 9, 2) AS BIGINT)) % 20 * 16 % 20 = (20 - CAST('0x' || substr(q.id, 11) AS BIGINT) % 20) % 20),
k AS (SELECT *, row_number() OVER (PARTITION BY project_slug, embedder_id, qid ORDER BY s DESC, id) AS rank FROM p),
m AS (SELECT project_slug, embedder_id, qid, node_id, max(s) AS vector_score, arg_min(id, rank) AS chunk_id FROM k WHERE rank <= 30 GROUP BY ALL),
w AS (SELECT m.*, coalesce(n.kind, 'chunk') AS kind, n.name, round(vector_score * ({_WEIGHT}), 6) AS score FROM m LEFT JOIN n ON n.project_slug = m.project_slug AND n.id = m.node_id),
t AS (SELECT *, max(score) OVER (PARTITION BY project_slug, embedder_id, qid) AS top, count(*) FILTER (vector_score < 0.4) OVER (PARTITION BY project_slug, embedder_id, qid) AS filtered FROM w)
SELECT * FROM (SELECT project_slug, embedder_id, qid, row_number() OVER (PARTITION BY project_slug, embedder_id, qid ORDER BY score DESC, node_id) AS position, node_id, kind, name, chunk_id, vector_score, score,
  CASE WHEN top >= 0.65 THEN 'high' WHEN top >= 0.55 THEN 'medium' ELSE 'low' END AS confidence, filtered FROM t WHERE vector_score >= 0.4) WHERE position <= 10""",
    "get_full_block": """
WITH l AS (SELECT doc_id, text, captured_at, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) AS raw FROM documents),
m AS (SELECT *, list_transform(raw, lambda x: CASE WHEN ends_with(x, chr(13)) THEN left(x, length(x) - 1) ELSE x END) AS lines, CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN 0 ELSE len(raw) END AS total FROM l),
e AS (SELECT *, CASE WHEN text IS NULL THEN 'file_not_found' WHEN total < 2 THEN 'range_out_of_bounds' END AS error_code FROM m)
SELECT CAST(doc_id AS VARCHAR) AS file_path, CASE WHEN error_code IS NULL THEN 1 END AS start_line, CASE WHEN error_code IS NULL THEN least(total, 5) END AS end_line, CASE WHEN error_code IS NULL THEN least(total, 5) END AS line_count,
       total AS total_file_lines, CASE WHEN error_code IS NULL THEN sha256(array_to_string(lines[1:5], chr(10))) END AS digest, error_code IS NULL AND total < 4 AS truncated_to_eof, coalesce(captured_at > TIMESTAMP '2025-06-01', false) AS stale, error_code FROM e""",
    "get_node_body": f"""
WITH {_N},
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS r FROM chunks) WHERE r = 1 AND node_id IS NOT NULL AND text IS NOT NULL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_slug, node_id ORDER BY file_path NULLS FIRST, start_byte NULLS FIRST, id) AS k FROM c) WHERE k = 1)
SELECT n.project_slug, n.id AS node_id, n.kind, f.symbol, n.a->>'$.class_fqn' AS container_class, coalesce(n.a->>'$.file', f.file_path) AS file, f.start_line, f.end_line, f.id AS chunk_id,
       sha256(array_to_string(list_transform(string_split(f.text, chr(10)), lambda x: CASE WHEN ends_with(x, chr(13)) THEN left(x, length(x) - 1) ELSE x END), chr(10))) AS digest
FROM f JOIN n ON n.project_slug = f.project_slug AND n.id = f.node_id""",
    "chunk_documents": """
WITH l AS (SELECT doc_id, i, CASE WHEN ends_with(raw[i], chr(13)) AND i < len(raw) THEN left(raw[i], length(raw[i]) - 1) ELSE raw[i] END AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS raw FROM documents WHERE text IS NOT NULL) d, unnest(range(1, len(raw) + 1)) AS u(i)),
m AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM l),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m WHERE NOT blank),
p AS (SELECT doc_id, CAST(min(i) AS INT) AS start_line, CAST(max(i) AS INT) AS end_line, string_agg(line, chr(10) ORDER BY i) AS body FROM g GROUP BY doc_id, island)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS piece_no, start_line, end_line, length(body) AS n_chars, sha256(body) AS digest FROM p""",
    "chunk_ids": """
SELECT id, substr(sha1(concat_ws(':', file_path, start_byte, end_byte)), 1, 16) AS computed, CAST(greatest(1, floor(length(coalesce(text, '')) / 4)) AS INT) AS tokens, end_byte - start_byte AS byte_length, end_line - start_line + 1 AS line_count
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS r FROM chunks) WHERE r = 1""",
    "embedding_cache": "SELECT sha256('hashing-v1:' || text) AS key, count(*) AS uses FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "orphan_vectors": "SELECT DISTINCT id FROM vectors WHERE id NOT IN (SELECT id FROM chunks WHERE text IS NOT NULL AND text <> '' AND id IS NOT NULL)",
    "embedding_cost": "SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(floor(sum(strlen(text)) * 0.3 / 4) AS BIGINT) AS tokens, round(floor(sum(strlen(text)) * 0.3 / 4) / 1e6 * 0.02, 6) AS usd FROM chunks WHERE text IS NOT NULL",
    "vector_upsert": """WITH new AS (SELECT embedder_id, id, max(embedded_at) AS embedded_at FROM vectors WHERE embedded_at >= '2025-05-01' AND embedder_id IS NOT NULL GROUP BY ALL),
old AS (SELECT embedder_id, id, max(embedded_at) AS embedded_at FROM vectors WHERE embedded_at < '2025-05-01' AND embedder_id IS NOT NULL GROUP BY ALL)
SELECT * FROM new UNION ALL SELECT o.* FROM old o WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.embedder_id = o.embedder_id AND new.id = o.id)""",
}

ORACLE["search_annotations"] = f"""
WITH {_N}, hits AS (SELECT DISTINCT project_slug, node_id FROM ({ORACLE['semantic_search']}) WHERE kind = 'method'),
own AS (SELECT project_slug, source AS node_id, arg_min(target, edge_seq) AS owner FROM edges WHERE kind = 'part_of' GROUP BY ALL),
rts AS (SELECT project_slug, node_id, string_agg(DISTINCT label, '; ' ORDER BY label) AS related_routes FROM (
  SELECT e.project_slug, e.target AS node_id, concat_ws(' ', array_to_string(CAST(n.a->'$.methods' AS VARCHAR[]), ','), n.a->>'$.uri') AS label FROM edges e JOIN n ON n.project_slug = e.project_slug AND n.id = e.source WHERE e.kind = 'routes_to') GROUP BY ALL)
SELECT h.project_slug, h.node_id, related_routes, coalesce(n.a->>'$.class_fqn', CASE WHEN starts_with(owner, 'class:') THEN substr(owner, 7) ELSE owner END) AS container_class
FROM hits h LEFT JOIN n ON n.project_slug = h.project_slug AND n.id = h.node_id LEFT JOIN own ON own.project_slug = h.project_slug AND own.node_id = h.node_id LEFT JOIN rts ON rts.project_slug = h.project_slug AND rts.node_id = h.node_id"""
ORACLE["enriched_chunks"] = f"""
WITH {_N},
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS r FROM chunks) WHERE r = 1 AND text IS NOT NULL AND text <> ''),
t AS (SELECT e.project_slug, e.source AS node_id, array_to_string(list_sort(list(DISTINCT n.name) FILTER (e.kind = 'fires'))[1:5], ', ') AS fires, array_to_string(list_sort(list(DISTINCT n.name) FILTER (e.kind = 'dispatches'))[1:5], ', ') AS dispatches
      FROM edges e JOIN n ON n.project_slug = e.project_slug AND n.id = e.target WHERE e.kind IN ('fires', 'dispatches') GROUP BY ALL),
k AS (SELECT e.project_slug, e.target AS node_id, string_agg(concat_ws('::', n.a->>'$.class_fqn', n.name), ', ' ORDER BY edge_seq) AS callers
      FROM (SELECT *, row_number() OVER (PARTITION BY project_slug, target ORDER BY edge_seq) AS i FROM edges WHERE kind = 'calls') e JOIN n ON n.project_slug = e.project_slug AND n.id = e.source WHERE i <= 5 GROUP BY ALL)
SELECT c.project_slug, c.id, concat_ws(chr(10), concat_ws(': ', c.kind, coalesce(c.symbol, '')), CASE WHEN file_path || start_line || end_line <> '' THEN 'file: ' || file_path || ':' || start_line || '-' || end_line END,
       'namespace: ' || nullif(n.a->>'$.namespace', ''), 'class: ' || nullif(n.a->>'$.class_fqn', ''), 'fires: ' || nullif(fires, ''), 'dispatches: ' || nullif(dispatches, ''), 'called by: ' || nullif(callers, ''), '', 'source:', regexp_replace(c.text, '\\s+$', '')) AS text
FROM c LEFT JOIN n ON n.project_slug = c.project_slug AND n.id = c.node_id LEFT JOIN t ON t.project_slug = c.project_slug AND t.node_id = c.node_id LEFT JOIN k ON k.project_slug = c.project_slug AND k.node_id = c.node_id"""
