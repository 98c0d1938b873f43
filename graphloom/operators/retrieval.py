"""Vector retrieval: exact top-k by cosine for a stated set of queries, graph-aware re-ranking, and the vector store's updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph as G

#: Weights by node kind (1.0 for all others), confidence bounds and the weight of an unresolved chunk.
KIND_WEIGHTS = {"method": 1.20, "route": 1.20, "event": 1.15, "listener": 1.15, "job": 1.15, "policy": 1.10, "model": 1.10, "controller": 1.05, "form_request": 1.05, "class": 0.95}
CHUNK_WEIGHT = 0.90
HIGH, MEDIUM = 0.65, 0.55


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, as one expression; null for a zero vector or unequal lengths."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def _blocks(rows: DataFrame, counts: DataFrame, own: str, other: str, block: int) -> DataFrame:
    """Each row with its own block and one copy per block of the other side."""
    n_own, n_other = (F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int") for c in (own, other))
    at = rows.join(counts, "grp")
    return at.withColumn("mine", F.pmod(F.xxhash64("id"), n_own).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), n_other - 1)))


def _usable(frame: pd.DataFrame) -> pd.DataFrame:
    return frame[frame["vec"].map(lambda v: v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(np.any(v)))]


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_list()).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _grouped(frame: pd.DataFrame) -> dict[tuple[str, int], pd.DataFrame]:
    """The rows by group and length of vector. Not by pandas, whose hashing of text ends at a NUL character."""
    places: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(frame["grp"].tolist(), map(len, frame["vec"]))):
        places.setdefault(key, []).append(i)
    return {key: frame.iloc[rows] for key, rows in places.items()}


def _nearest(x: np.ndarray, qids: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """(qid, id, score): per query the k best and what equals the last of them when rounded."""
    out = []
    for lo in range(0, len(x), 256):
        s = x[lo : lo + 256] @ y.T
        least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(s), -2.0)
        row, column = np.nonzero(s >= least[:, None] - 1e-6)
        out.append(pd.DataFrame({"qid": qids[lo + row], "id": ids[column], "score": s[row, column]}))
    return pd.concat(out)


#: Queries up to this many, and this many numbers in them, are sent to the index instead of being met by it in blocks.
FEW_QUERIES, FEW_NUMBERS = 4_000, 2_000_000


def block_top_k(index: DataFrame, queries: DataFrame, k: int, min_score: float | None = None, block: int = 8_192, few: int = FEW_QUERIES) -> DataFrame:
    """(grp, qid, id, score, rank): the exact k most similar rows of (grp, id, vec) for each query of (grp, id, vec) of its group.

    A proven small number of queries goes to all tasks and the index is not moved at all: each task keeps its best and those are
    merged. Beyond it both sides are cut into blocks by size, and one task compares one pair of blocks, whatever the size of a
    group. Vectors of another length than the query's, null ones and those without direction never match. Ties go to the smaller id.
    """
    kind = index.schema["id"].dataType.simpleString()
    schema = f"grp string, qid {kind}, id {kind}, score double"
    size = queries.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("numbers")).first()
    if size["rows"] <= few and size["numbers"] <= FEW_NUMBERS:
        asked = _usable(queries.select("grp", "id", "vec").toPandas())
        groups = {key: (_unit(g["vec"]), g["id"].to_numpy()) for key, g in _grouped(asked).items()}
        shared = index.sparkSession.sparkContext.broadcast(groups)

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, have in _grouped(_usable(batch)).items():
                    if key in shared.value:
                        found = _nearest(*shared.value[key], _unit(have["vec"]), have["id"].to_numpy(), k)
                        found.insert(0, "grp", key[0])
                        yield found

        found = index.select("grp", "id", "vec").mapInPandas(near, schema)
    else:
        counts = index.groupBy("grp").agg(F.count("*").alias("n_index")).join(queries.groupBy("grp").agg(F.count("*").alias("n_query")), "grp")
        i = _blocks(index.select("grp", "id", "vec"), counts, "n_index", "n_query", block).select("grp", F.col("mine").alias("ib"), F.col("theirs").alias("qb"), F.lit(False).alias("is_query"), "id", "vec")
        q = _blocks(queries.select("grp", "id", "vec"), counts, "n_query", "n_index", block).select("grp", F.col("theirs").alias("ib"), F.col("mine").alias("qb"), F.lit(True).alias("is_query"), "id", "vec")

        def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"qid": pd.Series(dtype=object), "id": pd.Series(dtype=object), "score": pd.Series(dtype=float)})]
            frame = _usable(frame)
            for _, same in frame.groupby(frame["vec"].map(len)):
                ask, have = same[same["is_query"]], same[~same["is_query"]]
                if len(ask) and len(have):
                    out.append(_nearest(_unit(ask["vec"]), ask["id"].to_numpy(), _unit(have["vec"]), have["id"].to_numpy(), k))
            found = pd.concat(out[1:] or out)
            found.insert(0, "grp", key[0])
            return found

        found = i.unionByName(q).groupBy("grp", "qb", "ib").applyInPandas(search, schema)
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    found = found.withColumn("score", F.round("score", 6))
    w = Window.partitionBy("grp", "qid").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def latest_vectors(vectors: DataFrame) -> DataFrame:
    """One row per (embedder_id, id), the one embedded last; usable vectors only."""
    ok = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    w = Window.partitionBy("embedder_id", "id").orderBy(F.col("embedded_at").desc_nulls_last(), F.xxhash64("vector").desc())
    return vectors.where(ok).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def kind_weight(kind: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in KIND_WEIGHTS.items() for x in pair])
    return F.when(kind.isNull(), CHUNK_WEIGHT).otherwise(F.coalesce(weights[kind], F.lit(1.0)))


def semantic_search(g: G.Graph, vectors: DataFrame, queries: DataFrame, top_k: int = 30, final_k: int = 10, min_vector_score: float = 0.4) -> DataFrame:
    """Hits per query, re-ranked: (project_slug, embedder_id, qid, position, node_id, kind, name, chunk_id, vector_score, score, confidence, filtered).

    ``queries`` has the columns of ``vectors``. The k best chunks become one row per node (the best chunk; chunks without a node
    stand for themselves), weighted by the node's kind; rows below the least vector score are counted and dropped; the
    confidence is that of the best re-ranked row.
    """
    grp = F.concat_ws("\x00", "project_slug", "embedder_id")
    hits = block_top_k(vectors.select(grp.alias("grp"), "id", F.col("vector").alias("vec")), queries.select(grp.alias("grp"), "id", F.col("vector").alias("vec")), top_k)
    payload = vectors.select(grp.alias("grp"), "id", "project_slug", "embedder_id", F.coalesce(F.nullif(F.col("payload.node_id"), F.lit("")), F.concat(F.lit("chunk:"), "id")).alias("node_id"))
    rows = hits.join(payload, ["grp", "id"])
    per_node = rows.groupBy("project_slug", "embedder_id", "qid", "node_id").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), F.col("id").alias("chunk_id"))).alias("h"))
    nodes = g.nodes.select("project_slug", F.col("id").alias("node_id"), "kind", "name")
    rows = per_node.join(nodes, ["project_slug", "node_id"], "left").select("project_slug", "embedder_id", "qid", "node_id", F.coalesce("kind", F.lit("chunk")).alias("kind"), "name", "h.chunk_id", F.col("h.score").alias("vector_score"), F.round(F.col("h.score") * kind_weight(F.col("kind")), 6).alias("score"))
    per = ["project_slug", "embedder_id", "qid"]
    order = Window.partitionBy(*per).orderBy(F.col("score").desc(), "node_id")
    passes = F.col("vector_score") >= min_vector_score
    everyone = Window.partitionBy(*per)
    rows = rows.withColumns({"top": F.max("score").over(everyone), "filtered": F.count_if(~passes).over(everyone)}).where(passes)
    rows = rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= final_k)
    confidence = F.when(F.col("top") >= HIGH, "high").when(F.col("top") >= MEDIUM, "medium").otherwise("low")
    return rows.select(*per, "position", "node_id", "kind", "name", "chunk_id", "vector_score", "score", confidence.alias("confidence"), "filtered")


def annotate_hits(g: G.Graph, hits: DataFrame) -> DataFrame:
    """Hits with container_class and, for methods, related_routes (``GET,POST /uri``, sorted)."""
    owner = g.edges_of("part_of").groupBy("project_slug", F.col("source").alias("node_id")).agg(F.min_by("target", "edge_seq").alias("owner"))
    routes = G.with_sources(g, g.edges_of("routes_to")).groupBy("project_slug", F.col("target").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", F.array_join("source_a.methods", ","), "source_a.uri"))), "; ").alias("related_routes"))
    a = g.nodes.select("project_slug", F.col("id").alias("node_id"), F.col("a.class_fqn").alias("class_fqn"))
    return hits.join(a, ["project_slug", "node_id"], "left").join(owner, ["project_slug", "node_id"], "left").join(routes, ["project_slug", "node_id"], "left").withColumn("container_class", F.coalesce("class_fqn", G.class_fqn(F.col("owner")))).drop("class_fqn", "owner")


# --- store updates ----------------------------------------------------------------------------------------------------


def upsert(existing: DataFrame, new: DataFrame, key: list[str], latest_by: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``existing`` with the same key; within ``new`` one row per key stays (the latest)."""
    if latest_by:
        w = Window.partitionBy(*key).orderBy(F.col(latest_by).desc_nulls_last(), F.xxhash64(*new.columns))
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates(key)
    return existing.join(new, key, "left_anti").unionByName(new)


def delete_ids(existing: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    return existing.join(ids.select(*key).distinct(), key, "left_anti")


def orphans(stored: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Keys stored but no longer current."""
    return stored.select(*key).distinct().join(current.select(*key), key, "left_anti")
