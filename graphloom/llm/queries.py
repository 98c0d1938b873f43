"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import mixing, neighbours, packing, splitting, tokens, truncation
from graphloom.session import shared_dir, table, written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.most_similar(table(spark, d, "vectors"), table(spark, d, "embedder_configs"), min_similarity=0.8)
    return neighbours.similar_pairs(found)


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.most_similar(table(spark, d, "vectors"), table(spark, d, "embedder_configs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.weakest_boundary(splitting.split_oversized(table(spark, d, "chunks"), with_text=False))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


_sizes: dict[tuple, DataFrame] = {}


def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n_tokens) as a stored table: encoding is by far the dearest step, so a session encodes a table once.

    A table whose files or times of change differ is encoded again.
    """
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    changed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = (spark.sparkContext.applicationId, shared_dir(spark), changed, *docs.inputFiles())
    if key not in _sizes:
        _sizes[key] = written(tokens.with_tokens(docs, "text").select("doc_id", "source", "n_tokens"))
    return _sizes[key]


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(document_sizes(spark, d), table(spark, d, "context_budgets"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, d), table(spark, d, "context_budgets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(document_sizes(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = document_sizes(spark, d), table(spark, d, "mix_targets")
    return mixing.share_report(docs, targets, mixing.mix(docs, targets))


def p7_shares_searched(spark: SparkSession, d: str) -> DataFrame:
    """The shares if each source keeps the best of 32 seeds."""
    docs, targets = document_sizes(spark, d), table(spark, d, "mix_targets")
    return mixing.share_report(docs, targets, mixing.mix(docs, targets, seeds=32))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).where("truncated").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(truncation.truncated(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p3_found, p3_pieces, p6_pack, p6_fill, p7_mix, p7_shares, p7_shares_searched, p8_found, p8_rates)}

_LATEST_CHUNKS = """
latest AS (
  SELECT id, text FROM (
    SELECT id, CASE WHEN strlen(text) > 1600 THEN text END AS text, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, CASE WHEN strlen(text) > 1600 THEN text END DESC NULLS LAST) AS n FROM chunks)
  WHERE n = 1 AND text IS NOT NULL)"""

ORACLE = {
    # Every vector against all of its embedder: what the partitions may miss a share of.
    "p1_found": """
WITH lengths AS (SELECT embedder_id, len(vector) AS dim, count(*) AS n FROM vectors WHERE vector IS NOT NULL GROUP BY ALL),
dims AS (SELECT embedder_id, coalesce(c.dimensions, l.dim) AS dim FROM (SELECT embedder_id, arg_max(dim, (n, dim)) AS dim FROM lengths GROUP BY 1) l
         LEFT JOIN (SELECT embedder_id, max(dimensions) AS dimensions FROM embedder_configs GROUP BY 1) c USING (embedder_id)),
usable AS (SELECT embedder_id, id, arg_max(vector, coalesce(embedded_at, TIMESTAMP '0001-01-01')) AS v FROM vectors JOIN dims USING (embedder_id)
           WHERE id IS NOT NULL AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY ALL),
wide AS (SELECT embedder_id, id, CAST(v AS DOUBLE[]) AS v FROM usable),
near AS (SELECT a.embedder_id, a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS s FROM wide a JOIN wide b ON a.embedder_id = b.embedder_id AND a.id <> b.id),
best AS (SELECT *, row_number() OVER (PARTITION BY embedder_id, id ORDER BY s DESC, other) AS r FROM near)
SELECT DISTINCT embedder_id, least(id, other) AS id_a, greatest(id, other) AS id_b FROM best WHERE r <= 5 AND s >= 0.8""",
    "p3_found": f"""
WITH {_LATEST_CHUNKS},
lines AS (SELECT id, text, string_split(text, chr(10)) AS l FROM latest),
runs AS (
  SELECT id, text, l,
         string_split(array_to_string(list_transform(l, lambda x: CASE WHEN trim(x, ' ' || chr(9) || chr(13)) = '' THEN chr(1) ELSE x END), chr(10)), chr(1)) AS r
  FROM lines)
SELECT id,
       CASE WHEN list_max(list_transform(r, lambda x: strlen(trim(x, chr(10))))) <= 1600 THEN 'blank_line'
            WHEN list_max(list_transform(l, lambda x: strlen(x))) <= 1600 THEN 'line'
            WHEN list_max(list_transform(regexp_split_to_array(text, '[ \\t\\r\\n]'), lambda x: strlen(x))) <= 1600 THEN 'space'
            ELSE 'none' END AS boundary
FROM runs""",
}
