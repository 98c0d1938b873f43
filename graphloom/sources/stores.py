"""Stored tables: the graph (replaced as a whole), vectors, project metadata, traces, configuration and package metadata."""

from __future__ import annotations

import json
import os
import subprocess
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators import graph as G
from graphloom.operators import retrieval
from graphloom.operators.incremental import CommitLog

#: Node kinds renamed since older data.
RENAMED_KINDS = {"controller_method": "method"}


class TableStore:
    """Versions of a set of tables under a root; one pointer file names the current one, so a replacement is atomic."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._log = CommitLog(spark, self.root)

    def replace(self, **tables: DataFrame) -> None:
        from graphloom.operators.incremental import Commit

        last = self._log.last()
        folder = f"{self.root}/version-{uuid.uuid4().hex}"
        for name, df in tables.items():
            (df.write.partitionBy("kind") if name in ("nodes", "edges") else df.write).parquet(f"{folder}/{name}")
        schemas = json.dumps({name: df.schema.json() for name, df in tables.items()})  # an empty table's files may not tell
        self._log.publish(Commit((last.seq if last else 0) + 1, folder if tables else "", "", [schemas]))

    def read(self, name: str) -> DataFrame | None:
        last = self._log.last()
        if last is None or last.output == "":
            return None
        schema = StructType.fromJson(json.loads(json.loads(last.decided[0])[name]))
        return self.spark.read.schema(schema).parquet(f"{last.output}/{name}")

    def clear(self) -> None:
        self.replace()


class GraphStore(TableStore):
    """nodes, edges and warnings as raw tables with attributes as JSON text."""

    def persist(self, nodes: DataFrame, edges: DataFrame, warnings: DataFrame) -> None:
        """Replace the graph. Edges whose source is no node are dropped and counted in a warning per project."""
        known = nodes.select("project_slug", F.col("id").alias("source"))
        lost = edges.join(known, ["project_slug", "source"], "left_anti").groupBy("project_slug").agg(F.count("*").cast("string").alias("context"))
        lost = lost.select("project_slug", F.lit("dangling_edges_dropped").alias("code"), "context")
        self.replace(nodes=nodes, edges=edges.join(known, ["project_slug", "source"], "left_semi"), warnings=warnings.unionByName(lost))

    def load(self) -> G.Graph | None:
        nodes = self.read("nodes")
        if nodes is None:
            return None
        renamed = F.coalesce(F.create_map(*[F.lit(x) for p in RENAMED_KINDS.items() for x in p])[F.col("kind")], "kind")
        return G.parsed(nodes.withColumn("kind", renamed), self.read("edges"))

    def node_count(self) -> int:
        nodes = self.read("nodes")
        return 0 if nodes is None else nodes.count()

    def edge_count(self) -> int:
        edges = self.read("edges")
        return 0 if edges is None else edges.count()


class VectorStore(TableStore):
    """vectors(id, vector, payload) of one dimension."""

    def __init__(self, spark: SparkSession, root: str, dimensions: int):
        super().__init__(spark, root)
        self.dimensions = dimensions

    def upsert(self, rows: DataFrame) -> None:
        """Add or replace by id; a null vector or one of another length raises an error and changes nothing."""
        wrong = rows.where(F.coalesce(F.size("vector") != self.dimensions, F.lit(True)) | F.col("vector").isNull()).count()
        if wrong:
            raise ValueError(f"{wrong} vectors do not have {self.dimensions} dimensions")
        old = self.read("vectors")
        self.replace(vectors=rows.dropDuplicates(["id"]) if old is None else retrieval.upsert(old, rows, ["id"]))

    def delete(self, ids: DataFrame) -> None:
        old = self.read("vectors")
        if old is not None:
            self.replace(vectors=retrieval.delete_ids(old, ids, ["id"]))

    def purge(self, current: DataFrame) -> None:
        """Delete every vector whose id is not among the current chunks."""
        old = self.read("vectors")
        if old is not None:
            self.replace(vectors=old.join(current.select("id").distinct(), "id", "left_semi"))

    def count(self) -> int:
        rows = self.read("vectors")
        return 0 if rows is None else rows.count()

    def search(self, queries: DataFrame, k: int) -> DataFrame | None:
        """(qid, id, score, rank) for queries (id, vec); None without a table."""
        rows = self.read("vectors")
        if rows is None:
            return None
        one = F.lit("all").alias("grp")
        return retrieval.block_top_k(rows.select(one, "id", F.col("vector").alias("vec")), queries.select(one, "id", "vec"), k).drop("grp")


# --- small files ------------------------------------------------------------------------------------------------------


def write_meta(path: str, meta: dict) -> None:
    """Project metadata as JSON with ``updated_at``, by way of a temporary file."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    aside = target.with_suffix(f".{uuid.uuid4().hex}")
    aside.write_text(json.dumps(meta | {"updated_at": datetime.now(timezone.utc).isoformat()}, indent=2))
    os.replace(aside, target)


def read_meta(path: str) -> dict | None:
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None


def load_config(path: str, major: int = 1) -> dict:
    """A YAML configuration whose schema_version has the expected major number; missing means empty."""
    import yaml

    if not Path(path).exists():
        return {}
    config = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(config, dict) or str(config.get("schema_version", major)).split(".")[0] != str(major):
        raise ValueError(f"unsupported configuration: {path}")
    return config


def package_metadata(path: str, tag: str | None = None, branch: str | None = None) -> dict:
    """name, version (stated, else the tag without its v, else dev-<branch>), psr-4 prefixes and required packages of a composer.json."""
    data = json.loads(Path(path).read_text())
    version = data.get("version") or (tag.lstrip("v") if tag else None) or (f"dev-{branch}" if branch else None)
    return {"name": data.get("name"), "version": version, "psr4": (data.get("autoload") or {}).get("psr-4") or {}, "requires": sorted({*(data.get("require") or {}), *(data.get("require-dev") or {})})}


def changed_files(repository: str, last_commit: str | None, suffix: str = ".php") -> list[str] | None:
    """Files changed since a commit; None if everything has to be processed."""
    if not last_commit:
        return None
    done = subprocess.run(["git", "-C", repository, "diff", "--name-only", f"{last_commit}..HEAD"], capture_output=True, text=True)
    return None if done.returncode else sorted(f for f in done.stdout.splitlines() if f.endswith(suffix))


# --- traces -----------------------------------------------------------------------------------------------------------

TRACE = "ts string, trace_id string, schema_version int, kind string, query string, tool string, duration_ms double, error_code string, confidence double"


def append_traces(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace records from JSON lines; malformed lines are skipped."""
    return spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path)


def trace_records(texts: DataFrame, text: str = "text") -> DataFrame:
    """Trace records from texts of JSON lines; lines that are no JSON object are skipped."""
    lines = texts.select(F.explode(F.split(text, "\n")).alias("line")).where(F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull())
    return lines.select(F.from_json("line", TRACE).alias("r")).select("r.*")


def trace_summary(records: DataFrame) -> DataFrame:
    """(trace_id, queries, tool_calls, duration_ms, outcome) per trace."""
    return records.groupBy("trace_id").agg(
        F.array_join(F.array_sort(F.collect_set("query")), "; ").alias("queries"),
        F.count_if(F.col("kind") == "tool_executed").alias("tool_calls"),
        F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("duration_ms"),
        F.when(F.coalesce(F.max(F.col("kind") == "ask_refusal"), F.lit(False)), "refused").otherwise("answered").alias("outcome"),
    )
