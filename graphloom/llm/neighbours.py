"""The most similar vectors of every vector, by learned partitions.

On a bounded, hash-selected sample of each collection the exact neighbour graph is built and partitioned into balanced parts;
a small classifier then learns to predict a vector's part. Every vector is stored in its most probable part and sent, as a
query, to a few more of the most probable ones, where it is compared with all that is stored there. Both sides of a comparison
take its result as an answer, so two vectors miss each other only if neither looks where the other is stored. Collections too
large for one set of parts are partitioned again, part by part; a vector divides its probes among the parts it goes to, so
deeper levels send no more copies. Vectors travel and are compared as 16-bit whole numbers with a scale of their own, which moves a
similarity by about 0.00001. Exact copies are searched once: a group of equal vectors is represented by its least
id and expanded afterwards, to no more members than can be among the answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import broadcast_if_small, materialize, written


@dataclass(frozen=True)
class Params:
    """Bounds and sizes. ``sample`` is the expected number of rows per cell, selected by a hash of the id, that a
    classifier is fitted on (more parts take more, 64 each); ``broadcast_bytes`` the size up to which classifiers go to every worker."""

    k: int = 5
    rows_per_part: int = 2_000
    max_parts: int = 256
    sample: int = 8_000
    graph_degree: int = 10
    probes: int = 5
    least_probes: int = 2
    sure: float = 0.99
    epochs: int = 120
    block: int = 8_192
    broadcast_bytes: int = 64 << 20


# --- fitting, on the sample of one cell -------------------------------------------------------------------------------


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Indices of the ``degree`` most similar rows of each row, itself left out."""
    n = len(x)
    degree = min(degree, n - 1)
    out = np.empty((n, degree), np.int32)
    for lo in range(0, n, 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each row: balanced bisection along main directions, then label propagation over the graph within a capacity."""
    n = len(x)
    labels = np.zeros(n, np.int32)
    todo, used = [(np.arange(n), parts)], 0
    rng = np.random.default_rng(7)
    while todo:
        rows, count = todo.pop()
        if count == 1 or len(rows) < 2:
            labels[rows] = used
            used += 1
            continue
        y = x[rows] - x[rows].mean(0)
        v = rng.standard_normal(x.shape[1]).astype(np.float32)
        for _ in range(8):  # power iteration
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-12
        order = np.argsort(y @ v, kind="stable")
        left = count // 2
        at = len(rows) * left // count
        todo += [(rows[order[at:]], count - left), (rows[order[:at]], left)]
    capacity = max(2, int(slack * n / parts) + 1)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int16)
        for j in range(graph.shape[1]):
            np.add.at(votes, (np.arange(n), labels[graph[:, j]]), 1)
        want = votes.argmax(1).astype(np.int32)
        gain = votes[np.arange(n), want] - votes[np.arange(n), labels]
        movers = np.flatnonzero(gain > 0)
        if not len(movers):
            break
        size = np.bincount(labels, minlength=parts)
        for i in movers[np.argsort(-gain[movers], kind="stable")]:
            if size[want[i]] < capacity:
                size[labels[i]] -= 1
                size[want[i]] += 1
                labels[i] = want[i]
    return labels


def fit_classifier(x: np.ndarray, target: np.ndarray, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax classifier towards soft targets, by Adam in mini-batches."""
    rng = np.random.default_rng(11)
    n, d = x.shape
    w, b = np.zeros((d, target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    step, batch = 0, 1024
    for epoch in range(epochs):
        rate = 0.3 * (1 - epoch / epochs) + 0.01
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            g = (softmax(x[rows] @ w + b) - target[rows]) / len(rows)
            step += 1
            for p, grad, i in ((w, x[rows].T @ g, 0), (b, g.sum(0), 2)):
                moments[i] = 0.9 * moments[i] + 0.1 * grad
                moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * grad * grad
                p -= rate * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 1] / (1 - 0.99**step)) + 1e-8)
    return w, b


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def packed(vector: np.ndarray) -> bytes:
    """A vector as a scale and 16-bit whole numbers."""
    scale = np.abs(vector).max() / 32767
    return np.float32(scale).tobytes() + np.rint(vector / scale).astype(np.int16).tobytes()


def to_matrix(column: pd.Series) -> np.ndarray:
    """Packed vectors, all of one length, as rows."""
    raw = np.frombuffer(b"".join(column), np.int16).reshape(len(column), -1)
    return raw[:, 2:].astype(np.float32) * np.ascontiguousarray(raw[:, :2]).view(np.float32)


def probes_of(prob: np.ndarray, most: np.ndarray | int, least: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """(parts by falling probability, how many of them to look in): the most probable ones until ``sure`` is reached."""
    most = np.minimum(np.broadcast_to(most, len(prob)), prob.shape[1])
    width = int(most.max(initial=1))
    order = np.argsort(-prob, axis=1, kind="stable")[:, :width]
    mass = np.cumsum(np.take_along_axis(prob, order, 1), axis=1)
    return order, np.clip((mass < sure).sum(1) + 1, np.minimum(least, most), most)


MODEL = "cell string, n bigint, dim int, parts int, weights binary, bias binary, index_share binary, query_share binary"


def _fitter(p: Params):
    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, m = to_matrix(frame["vec"]), int(frame["parts"].iloc[0])
        m = max(1, min(m, len(x) // 8))
        if m > 1:
            graph = neighbour_graph(x, p.graph_degree)
            labels = balanced_parts(x, graph, m)
            target = np.zeros((len(x), m), np.float32)
            np.add.at(target, (np.arange(len(x)), labels), 0.5)
            for j in range(graph.shape[1]):
                np.add.at(target, (np.arange(len(x)), labels[graph[:, j]]), 0.5 / graph.shape[1])
            w, b = fit_classifier(x, target, p.epochs)
        else:
            w, b = np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32)
        prob = softmax(x @ w + b)
        order, count = probes_of(prob, p.probes, p.least_probes, p.sure)
        stored = np.bincount(order[:, 0], minlength=m) / len(x)
        asked = np.bincount(order[np.arange(order.shape[1]) < count[:, None]], minlength=m) / len(x)
        row = (key[0], int(frame["n"].iloc[0]), x.shape[1], m, w.tobytes(), b.tobytes(), stored.astype(np.float32).tobytes(), asked.astype(np.float32).tobytes())
        return pd.DataFrame([row], columns=["cell", "n", "dim", "parts", "weights", "bias", "index_share", "query_share"])

    return fit


# --- routing and search -----------------------------------------------------------------------------------------------

#: ``member`` rows are stored in a cell and ask there, others only ask; ``probes`` is how many parts of it they may ask.
ROWS = "cell string, member boolean, probes int, h bigint, id string, vec binary"
ROUTED = ROWS + ", qb int, ib int, nq int, ni int"


def _route(g: pd.DataFrame, m: dict, p: Params) -> pd.DataFrame:
    """Rows of one cell with the parts they go to."""
    w = np.frombuffer(m["weights"], np.float32).reshape(m["dim"], m["parts"])
    prob = softmax(to_matrix(g["vec"]) @ w + np.frombuffer(m["bias"], np.float32))
    # Blocks of about p.block rows on either side; every pair of blocks of a part is one task's work.
    blocks = {side: np.maximum(1, np.ceil(np.frombuffer(m[f"{side}_share"], np.float32) * m["n"] / p.block)).astype(np.int64) for side in ("index", "query")}
    budget = g["probes"].to_numpy()
    order, count = probes_of(prob, budget, p.least_probes, p.sure)
    taken = np.arange(order.shape[1]) < count[:, None]
    mass = np.where(taken, np.take_along_axis(prob, order, 1), 0)
    share = 1 + np.floor((budget - count)[:, None] * mass / np.maximum(mass.sum(1, keepdims=True), 1e-9)).astype(np.int64)
    share[:, 0] += budget - np.where(taken, share, 0).sum(1)  # what is left of the probes
    row, place = np.nonzero(taken)
    part, h = order[row, place], g["h"].to_numpy()[row]
    out = g.iloc[row].reset_index(drop=True)
    out["cell"] = m["cell"] + "/" + pd.Series(part).astype(str)
    out["member"] = out["member"].to_numpy() & (place == 0)
    out["probes"] = share[row, place]
    for name, side in (("q", "query"), ("i", "index")):
        out[f"n{name}"] = blocks[side][part]
        out[f"{name}b"] = h % blocks[side][part]
    return out[["cell", "member", "probes", "h", "id", "vec", "qb", "ib", "nq", "ni"]]


def route(rows: DataFrame, models: DataFrame, p: Params) -> DataFrame:
    """Every row in the parts of its cell that its cell's classifier sends it to.

    Classifiers go to all workers if they are proven to be small. Beyond that they are joined to blocks of their cell's rows.
    """
    size = models.agg(F.sum(F.octet_length("weights") + F.lit(4096))).first()[0] or 0
    if size <= p.broadcast_bytes:
        known = rows.sparkSession.sparkContext.broadcast({r["cell"]: r.asDict() for r in models.collect()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for cell, g in batch.groupby("cell"):
                    yield _route(g, known.value[cell], p)

        return rows.mapInPandas(run, ROUTED)
    blocks = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("n") / F.lit(5 * p.block)))
    asked = rows.join(broadcast_if_small(models.select("cell", blocks.alias("blocks"))), "cell").withColumn("b", F.pmod("h", "blocks")).drop("blocks")
    spread = models.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))

    def route_block(g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        return _route(g, m.iloc[0].to_dict(), p) if len(g) else pd.DataFrame(columns=[c.split()[0] for c in ROUTED.split(", ")])

    return asked.groupBy("cell", "b").cogroup(spread.groupBy("cell", "b")).applyInPandas(route_block, ROUTED)


def best_of(s: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest values of each row, equal ones by column; values below ``least`` are left out."""
    if least is None:
        k = min(k, s.shape[1])
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(s, top, 1).min(1, keepdims=True)
        for i in np.flatnonzero((s >= last).sum(1) > k):  # equal values compete for the last place
            top[i] = np.argsort(-s[i], kind="stable")[:k]
        return np.repeat(np.arange(len(s)), k), top.ravel()
    row, column = np.nonzero(s >= least)
    if len(row) and np.bincount(row).max() > k:
        by = np.lexsort((column, -s[row, column], row))
        row, column = row[by], column[by]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, column = row[keep], column[keep]
    return row, column


FOUND = "grp string, q string, c string, sim double"


def _searcher(k: int, least: float | None):
    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        asks, held = frame["asks"].to_numpy(), frame["held"].to_numpy()
        ids, own = frame["id"].to_numpy(), frame["member"].to_numpy()
        q, c = np.flatnonzero(asks), np.flatnonzero(held)
        found: list[tuple] = []
        if len(q) and len(c):
            x = to_matrix(frame["vec"])
            y = x[c]
            place = np.full(len(frame), -1)
            place[c] = np.arange(len(c))
            for lo in range(0, len(q), 512):
                mine = q[lo : lo + 512]
                s = x[mine] @ y.T
                same = np.flatnonzero(place[mine] >= 0)
                s[same, place[mine[same]]] = -3.0
                row, column = best_of(s, k, least)
                found.append((mine[row], c[column], s[row, column]))
                guests = np.flatnonzero(~own[mine])  # those stored here ask here themselves
                if len(guests):
                    row, column = best_of(s[guests].T, k, least)
                    found.append((c[row], mine[guests[column]], s[guests[column], row]))
        if not found:
            return pd.DataFrame({"grp": pd.Series([], dtype=str), "q": pd.Series([], dtype=str), "c": pd.Series([], dtype=str), "sim": pd.Series([], dtype="float64")})
        asker, answer, sim = (np.concatenate([f[i] for f in found]) for i in range(3))
        by = np.lexsort((answer, -sim, asker))
        asker, answer, sim = asker[by], answer[by], sim[by]
        keep = (np.arange(len(asker)) - np.searchsorted(asker, asker) < k) & (sim > -2.5)
        return pd.DataFrame({"grp": key[0].split("/", 1)[0], "q": ids[asker[keep]], "c": ids[answer[keep]], "sim": sim[keep].astype(np.float64)})

    return search


def _normaliser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their vector scaled to unit length and packed."""
    for batch in batches:
        i = batch.schema.get_field_index("vec")
        column = batch.column(i)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(np.asarray([0, *column.value_lengths().to_pylist()]))
        vecs = []
        for a, b in zip(ends[:-1], ends[1:]):
            v = flat[a:b] / np.abs(flat[a:b]).max()  # keeps the square sum finite
            vecs.append(packed(v / np.sqrt(v @ v)))
        yield batch.set_column(i, "vec", pa.array(vecs, pa.binary()))


def expected_dimensions(vectors: DataFrame, configs: DataFrame) -> DataFrame:
    """(embedder_id, dim): as configured, else the most common vector length of that embedder (the longer one on ties)."""
    lengths = vectors.where("vector IS NOT NULL AND embedder_id IS NOT NULL").groupBy("embedder_id", F.size("vector").alias("len")).agg(F.count("*").alias("n"))
    common = lengths.groupBy("embedder_id").agg(F.max(F.struct("n", "len"))["len"].alias("common"))
    known = configs.where("embedder_id IS NOT NULL").groupBy("embedder_id").agg(F.max("dimensions").alias("dimensions"))
    return common.join(known, "embedder_id", "left").select("embedder_id", F.coalesce("dimensions", "common").alias("dim"))


def usable_vectors(vectors: DataFrame, configs: DataFrame) -> DataFrame:
    """(grp, id, vec): one packed unit vector per (embedder_id, id), from the latest usable row.

    Usable: embedder and id known, the embedder's length, only finite numbers, not all zero. Equal times go to the greater
    vector hash; a null time is the oldest. Other columns are ignored.
    """
    dims = expected_dimensions(vectors, configs)
    rows = vectors.select(F.col("embedder_id").alias("grp"), "id", "vector", "embedded_at").where("id IS NOT NULL AND vector IS NOT NULL")
    rows = rows.join(dims.select(F.col("embedder_id").alias("grp"), "dim"), "grp").where("size(vector) = dim")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    at = dict(rows.dtypes)["embedded_at"]
    rows = rows.select("grp", "id", "embedded_at", F.col("vector").alias("vec")).mapInArrow(_normaliser, f"grp string, id string, embedded_at {at}, vec binary")
    latest = Window.partitionBy("grp", "id").orderBy(F.col("embedded_at").desc_nulls_last(), F.xxhash64("vec").desc())
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select("grp", "id", "vec")


def copy_classes(units: DataFrame, keep: int) -> DataFrame:
    """(grp, rep, members, n): groups of equal vectors with their ``keep`` least ids; the first of them represents the group."""
    rows = units.select("grp", "id", F.sha2("vec", 256).alias("vh"))
    rank = Window.partitionBy("grp", "vh").orderBy("id")
    first = rows.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= keep)
    members = first.groupBy("grp", "vh").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return members.select("grp", "vh", F.col("members")[0].alias("rep"), "members")


def partition_search(reps: DataFrame, p: Params, min_similarity: float | None = None) -> DataFrame:
    """(grp, q, c, sim): for each row of (grp, id, vec) up to k most similar others of its group."""
    rows = reps.select(F.col("grp").alias("cell"), F.lit(True).alias("member"), F.lit(p.probes).alias("probes"), F.shiftrightunsigned(F.xxhash64("id"), 1).alias("h"), "id", "vec")
    level, before = 0, None
    while True:
        stored = rows.where("member")
        parts = F.least(F.lit(p.max_parts).cast("bigint"), F.ceil(F.col("n") / F.lit(p.rows_per_part)))
        sizes = stored.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", parts)
        sizes = written(sizes.withColumn("bound", F.least(F.lit(1.0), F.greatest(F.lit(p.sample), 64 * F.col("parts")) / F.col("n")) * (1 << 31)))
        largest = sizes.agg(F.max("n")).first()[0] or 0
        chosen = F.pmod(F.xxhash64(F.lit(level), "id"), F.lit(1 << 31)) <= F.col("bound")
        sample = stored.select("cell", "id", "vec").join(broadcast_if_small(sizes), "cell").where(chosen)
        models = written(sample.select("cell", "vec", "n", "parts").groupBy("cell").applyInPandas(_fitter(p), MODEL))
        routed = route(rows, models, p)
        # Beyond this the parts are partitioned again, unless that has ceased to make them smaller; their blocks are compared then.
        if largest <= 2 * p.max_parts * p.rows_per_part or (before is not None and largest > before / 2):
            break
        rows, level, before = written(routed.select(*(c.split()[0] for c in ROWS.split(", ")))), level + 1, largest
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda qb, ib, asks, held: F.struct(qb.alias("qb"), ib.alias("ib"), asks.alias("asks"), held.alias("held"))
    asking = F.transform(every("ni"), lambda i: pair(F.col("qb"), i, F.lit(True), F.col("member") & (i == F.col("ib"))))
    held = F.transform(F.filter(every("nq"), lambda i: F.col("member") & (i != F.col("qb"))), lambda i: pair(i, F.col("ib"), F.lit(False), F.lit(True)))
    spread = routed.select("cell", "member", "id", "vec", F.explode(F.concat(asking, held)).alias("b")).select("cell", "member", "id", "vec", "b.*")
    found = spread.groupBy("cell", "qb", "ib").applyInPandas(_searcher(p.k, min_similarity), FOUND)
    # One exchange by asker serves both the removal of what was found from either side and the choice of the best.
    found = found.repartition("grp", "q").groupBy("grp", "q", "c").agg(F.max("sim").alias("sim"))
    best = Window.partitionBy("grp", "q").orderBy(F.col("sim").desc(), "c")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= p.k).drop("_n")


def most_similar(vectors: DataFrame, configs: DataFrame, min_similarity: float | None = None, params: Params = Params()) -> DataFrame:
    """(embedder_id, id, other, similarity): up to k most similar vectors of the same embedder for every usable vector.

    Itself is left out; ties go to the smaller id. With ``min_similarity`` less similar ones are left out too. Vectors that
    are equal after scaling and packing are copies of one another. Of an embedder with one usable vector nothing
    comes out; empty tables give an empty result.
    """
    k = params.k
    units = written(usable_vectors(vectors, configs).withColumn("grp", F.hex("grp")))
    classes = copy_classes(units, k + 1)
    classes = materialize(classes)
    if classes.where(F.size("members") > 1).limit(1).count():
        reps = written(units.join(classes.select("grp", F.col("rep").alias("id")), ["grp", "id"], "left_semi"))
    else:
        reps = units
    near = partition_search(reps, params, min_similarity)
    own = classes.where(F.size("members") > 1).select("grp", F.col("rep").alias("q"), F.col("rep").alias("c"), F.lit(1.0).alias("sim"))
    # A group of more than k copies answers all its members' questions itself; others are expanded to members on both sides.
    asking = classes.select("grp", F.col("rep").alias("q"), F.explode("members").alias("id"))
    given = classes.select("grp", F.col("rep").alias("c"), F.explode("members").alias("other"))
    pairs = near.unionByName(own).join(asking, ["grp", "q"]).join(given, ["grp", "c"]).where("id <> other").select("grp", "id", "other", "sim")
    best = Window.partitionBy("grp", "id").orderBy(F.col("sim").desc(), "other")
    pairs = pairs.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")
    full = classes.where(F.size("members") > k).select("grp", "vh", "members")
    rest = units.select("grp", "id", F.sha2("vec", 256).alias("vh")).join(full, ["grp", "vh"]).where(F.col("id") > F.element_at("members", -1))
    rest = rest.select("grp", "id", F.explode(F.slice("members", 1, k)).alias("other"), F.lit(1.0).alias("sim"))
    return pairs.unionByName(rest).select(F.decode(F.unhex("grp"), "UTF-8").alias("embedder_id"), "id", "other", F.col("sim").alias("similarity"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """(embedder_id, id_a, id_b), id_a < id_b: each pair of which one is among the answers of the other, once."""
    return neighbours.select("embedder_id", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
