"""Texts as chunks and lines: identities, paragraph and source chunking, line ranges, enrichment and embedding inputs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph as G

CHUNK = "file_path string, kind string, start_byte int, end_byte int, start_line int, end_line int, text string, symbol string, namespace string"


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", path, start.cast("string"), end.cast("string"))), 1, 16)


def cache_key(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit(":"), text), 256)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def embedding_cost(files: DataFrame, size: str, usd_per_million: float, share: float = 0.30) -> DataFrame:
    """One row: bytes, tokens (30 % of the bytes, four to a token) and cost."""
    return files.agg(F.sum(size).alias("bytes")).select("bytes", F.floor(F.col("bytes") * share / 4).alias("tokens"), F.round(F.floor(F.col("bytes") * share / 4) / 1e6 * usd_per_million, 6).alias("usd"))


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk id, the one indexed last."""
    w = Window.partitionBy("id").orderBy(F.col("indexed_at").desc_nulls_last(), F.xxhash64("text").desc(), "project_slug", "file_path")
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def paragraphs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, piece_no, start_line, end_line, text): runs of non-blank lines, numbered from 0, lines from 1, as one expression."""
    kind = texts.schema[key].dataType.simpleString()
    arrays = texts.where(F.col(text).isNotNull()).select(F.col(key).cast(kind).alias("_key"), F.split(text, r"\r?\n").alias("l"))
    marked = arrays.withColumn("blank", F.transform("l", lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " ")) == ""))
    starts = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: ~F.col("blank")[i] & ((i == 0) | F.col("blank")[F.greatest(i - 1, F.lit(0))]))
    ends = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: ~F.col("blank")[i] & ((i == F.size("l") - 1) | F.col("blank")[F.least(i + 1, F.size("l") - 1)]))
    ranges = marked.select("_key", "l", F.posexplode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("piece_no", "r"))
    body = F.array_join(F.slice("l", F.col("r.s") + 1, F.col("r.e") - F.col("r.s") + 1), "\n")
    return ranges.select(F.col("_key").alias(key), "piece_no", (F.col("r.s") + 1).alias("start_line"), (F.col("r.e") + 1).alias("end_line"), body.alias("text"))


def read_block(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Line ranges of files: requests (file_path, start_line, end_line, context_lines, indexed_at) against files (file_path, text, mtime).

    The range is widened by the context and clamped to the file. error_code: invalid_range, file_not_found or
    range_out_of_bounds; ``stale`` if the file is newer than its index.
    """
    rows = requests.join(files.select("file_path", "text", "mtime"), "file_path", "left")
    lines = F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n")
    total = F.when(F.col("text").isNotNull(), F.when(F.col("text") == "", 0).otherwise(F.size(lines)))
    rows = rows.withColumns({"total_file_lines": total, "lines": lines})
    bad = (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line"))
    error = F.when(bad, "invalid_range").when(F.col("text").isNull(), "file_not_found").when(F.col("start_line") > F.col("total_file_lines"), "range_out_of_bounds")
    lo = F.greatest(F.lit(1), F.col("start_line") - F.col("context_lines"))
    hi = F.least(F.col("total_file_lines"), F.col("end_line") + F.col("context_lines"))
    ok = error.isNull()
    return rows.select(
        "file_path", F.when(ok, lo).alias("start_line"), F.when(ok, hi).alias("end_line"), F.when(ok, hi - lo + 1).alias("line_count"), "total_file_lines",
        F.when(ok, F.array_join(F.slice("lines", lo, hi - lo + 1), "\n")).alias("content"), (ok & (F.col("end_line") > F.col("total_file_lines"))).alias("truncated_to_eof"),
        F.coalesce(F.col("mtime") > F.col("indexed_at"), F.lit(False)).alias("stale"), error.alias("error_code"),
    )


def snippets(hits: DataFrame, files: DataFrame, snippet_lines: int = 30, context_lines: int = 2) -> DataFrame:
    """``hits`` (file_path, start_line, end_line and any others) with ``snippet``: their lines and a few around, cut after ``snippet_lines``.

    Null where the file (file_path, text) is not known or the hit names no lines; empty where the file ends before it.
    """
    texts = files.select(F.col("file_path").alias("_path"), F.col("text").alias("_text"))
    lines = F.when(F.col("_text") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("_text", r"\r?\n\z", ""), r"\r?\n"))
    first = F.greatest(F.lit(1), F.col("start_line") - context_lines)
    size = F.least(F.lit(snippet_lines), F.least(F.size("_lines"), F.col("end_line") + context_lines) - first + 1)
    found = F.when(F.col("_text").isNotNull() & F.col("start_line").isNotNull() & F.col("end_line").isNotNull(), F.when(size > 0, F.array_join(F.slice("_lines", first, size), "\n")).otherwise(""))
    return hits.join(texts, F.col("file_path") == F.col("_path"), "left").withColumn("_lines", lines).select(*[F.col(f"`{c}`") for c in hits.columns], found.alias("snippet"))


def node_bodies(g: G.Graph, chunks: DataFrame) -> DataFrame:
    """The source of each node: its first chunk (by file and position) of the latest index, the node's own file preferred."""
    c = latest_chunks(chunks).where("node_id IS NOT NULL AND text IS NOT NULL")
    first = c.groupBy("project_slug", F.col("node_id").alias("id")).agg(F.min(F.struct("file_path", "start_byte", F.col("id").alias("chunk_id"), "symbol", "start_line", "end_line", "text")).alias("c"))
    rows = g.nodes.join(first, ["project_slug", "id"])
    content = F.array_join(F.split("c.text", r"\r?\n"), "\n")
    return rows.select("project_slug", F.col("id").alias("node_id"), "kind", F.col("c.symbol").alias("symbol"), F.col("a.class_fqn").alias("container_class"), F.coalesce("a.file", "c.file_path").alias("file"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"), F.col("c.chunk_id").alias("chunk_id"), content.alias("content"))


def enrich_chunks(g: G.Graph, chunks: DataFrame, most: int = 5) -> DataFrame:
    """(project_slug, id, text): each chunk as it is embedded: header, namespace, what its node does and who calls it, then the source."""
    c = latest_chunks(chunks).where("text IS NOT NULL AND text <> ''")
    out = G.with_targets(g, g.edges_of("fires", "dispatches")).groupBy("project_slug", F.col("source").alias("node_id")).agg(*[F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("target_name")))), 1, most), ", ").alias(k) for k in ("fires", "dispatches")])
    w = Window.partitionBy("project_slug", "target").orderBy("edge_seq")
    callers = G.with_sources(g, g.edges_of("calls").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most))
    callers = callers.groupBy("project_slug", F.col("target").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_seq", F.concat_ws("::", "source_a.class_fqn", "source_name").alias("c")))), lambda x: x["c"]), ", ").alias("callers"))
    nodes = g.nodes.select("project_slug", F.col("id").alias("node_id"), F.col("a.class_fqn").alias("class_fqn"), F.col("a.namespace").alias("namespace"))
    rows = c.join(nodes, ["project_slug", "node_id"], "left").join(out, ["project_slug", "node_id"], "left").join(callers, ["project_slug", "node_id"], "left")
    line = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{label}: "), v))
    where = F.concat(F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    text = F.concat_ws(
        "\n", F.concat_ws(": ", "kind", F.coalesce("symbol", F.lit(""))), line("file", where), line("namespace", F.col("namespace")), line("class", F.col("class_fqn")), line("fires", F.col("fires")),
        line("dispatches", F.col("dispatches")), line("called by", F.col("callers")), F.lit(""), F.lit("source:"), F.rtrim(F.regexp_replace("text", r"\s+\z", "")),
    )
    return rows.select("project_slug", "id", text.alias("text"))


# --- source chunking --------------------------------------------------------------------------------------------------

_DECLARATION = re.compile(r"(?:(?:abstract|final|readonly)\s+)*(class|interface|trait|enum)\s+([A-Za-z_]\w*)[^{;]*\{|((?:(?:public|protected|private|static|abstract|final)\s+)*)function\s+&?\s*([A-Za-z_]\w*)\s*\([^{;]*?(?:\{|;)", re.S)
_NAMESPACE = re.compile(r"\bnamespace\s+([\w\\]+)\s*[;{]")
_DOC = re.compile(r"(/\*\*(?:(?!\*/).)*\*/)\s*(?:#\[[^\]]*\]\s*)*$", re.S)


def _masked(code: str) -> str:
    """The code with strings and comments blanked out, so that braces and words in them do not count; same length."""
    out, i, n = list(code), 0, len(code)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        two = code[i : i + 2]
        if two == "//" or (code[i] == "#" and code[i : i + 2] != "#["):
            end = code.find("\n", i)
            end = n if end < 0 else end
        elif two == "/*":
            end = code.find("*/", i + 2)
            end = n if end < 0 else end + 2
        elif code[i] in "'\"":
            end = i + 1
            while end < n and code[end] != code[i]:
                end += 2 if code[end] == "\\" else 1
            end += 1
        else:
            i += 1
            continue
        blank(i, end)
        i = end
    return "".join(out)


def _closing(masked: str, at: int) -> int:
    """Just behind the brace that closes the one before ``at``."""
    depth = 1
    for m in re.compile(r"[{}]").finditer(masked, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(masked)


def source_chunks(code: str, max_members: int = 80) -> list[tuple]:
    """(kind, start, end, text, symbol, namespace) of each class-like header, method and function; the whole file if there is none.

    A header's text is its doc comment, its declaration and the first line of each member, at most ``max_members`` of them.
    """
    masked, found = _masked(code), []
    spaces = [(m.start(), m.group(1)) for m in _NAMESPACE.finditer(masked)]
    owners: list[tuple[int, int, str]] = []
    for m in _DECLARATION.finditer(masked):
        namespace = next((name for at, name in reversed(spaces) if at < m.start()), None)
        doc = _DOC.search(code, 0, m.start())
        start = doc.start() if doc else m.start()
        end = _closing(masked, m.end()) if masked[m.end() - 1] == "{" else m.end()
        owner = next((o for o in reversed(owners) if o[0] <= m.start() < o[1]), None)
        full = lambda name: f"{namespace}\\{name}" if namespace else name  # noqa: B023, E731
        if m.group(1):
            owners.append((m.start(), end, full(m.group(2))))
            members = [x for x in _DECLARATION.finditer(masked, m.end(), end) if x.group(4)]
            heads = [code[x.start() : x.end()].split("\n")[0].rstrip(" {") for x in members[:max_members]]
            heads += [f"// ... {len(members) - max_members} more"] if len(members) > max_members else []
            found.append((f"{m.group(1)}_header", start, end, "\n".join([code[start : m.end()].rstrip(), *("    " + h for h in heads), "}"]), full(m.group(2)), namespace))
        elif owner:
            found.append(("method", start, end, code[start:end], f"{owner[2]}::{m.group(4)}", namespace))
        else:
            found.append(("function", start, end, code[start:end], full(m.group(4)), namespace))
    return found or [("file", 0, len(code), code, None, None)]


def chunk_sources(files: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """Chunks of source files with byte and line ranges and the chunk id; null and empty files give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, code in zip(batch["file_path"], batch["text"]):
                for kind, s, e, body, symbol, namespace in source_chunks(code):
                    sb = len(code[:s].encode())
                    out.append((name, kind, sb, sb + len(code[s:e].encode()), code.count("\n", 0, s) + 1, code.count("\n", 0, max(s, e - 1)) + 1, body, symbol, namespace))
            yield pd.DataFrame(out, columns=["file_path", "kind", "start_byte", "end_byte", "start_line", "end_line", "text", "symbol", "namespace"])

    rows = files.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(path).alias("file_path"), F.col(text).alias("text"))
    return rows.mapInPandas(run, CHUNK).withColumn("id", chunk_id(F.col("file_path"), F.col("start_byte"), F.col("end_byte")))


# --- embedding --------------------------------------------------------------------------------------------------------


class HashingEmbedder:
    """A deterministic embedder: words hashed into signed dimensions, scaled to unit length. Any object with model_id, dimensions and embed fits."""

    def __init__(self, dimensions: int = 64, model_id: str = "hashing-v1"):
        self.dimensions, self.model_id = dimensions, model_id

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                row[h % self.dimensions] += 1.0 if h & 0x80000000 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embed_missing(texts: DataFrame, cache: DataFrame, embedder, batch: int = 256) -> tuple[DataFrame, DataFrame]:
    """(vectors by text, new cache rows): texts (id, text) found in the cache (key, vector) are joined, the others embedded once per distinct text.

    A cache row without a vector of the embedder's dimensions counts as a miss.
    """
    keyed = texts.select("id", "text", cache_key(F.lit(embedder.model_id), F.col("text")).alias("key"))
    good = cache.where(F.size("vector") == embedder.dimensions).dropDuplicates(["key"]).select("key", "vector")
    missing = keyed.select("key", "text").join(good, "key", "left_anti").dropDuplicates(["key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({"key": part["key"], "vector": list(embedder.embed(part["text"].tolist()))})

    fresh = missing.mapInPandas(run, "key string, vector array<float>")
    return keyed.join(good.unionByName(fresh), "key").select("id", "vector"), fresh
