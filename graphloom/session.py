"""Session defaults and the few helpers that touch cluster state."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", app: str = "graphloom", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; keyword arguments override them (``__`` stands for a dot).

    On a cluster shuffles start with many partitions, which adaptive execution merges; it never splits too few of them.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8" if master.startswith("local") else "4000",
        "spark.checkpoint.compress": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``. Where it is unset a temporary one is made, in local mode only."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can read")
        known = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder, so that several consumers share one computation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as a table written to the shared folder: its readers take only the columns and rows they ask for."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Mark ``df`` for broadcast only if it is proven to hold at most ``max_rows`` rows; else leave the choice to the planner."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int = 200_000) -> DataFrame:
    """``left`` joined with ``right`` on ``key`` ("inner" or "left"), where a few keys may hold much of ``left``.

    A key with more than ``most`` rows of ``left``, and more than a thousandth of all, is spread over several tasks: its rows
    of ``left`` by a hash, those of ``right`` repeated. By that bound there are at most 1,000 such keys.
    """
    total = left.count()
    bound = max(most, total // 1000)
    if total <= bound:
        return left.join(right, key, how)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > bound)
    hot = [(r[key], -(-r["n"] // bound)) for r in counts.collect()]
    if not hot:
        return left.join(right, key, how)
    salts = F.broadcast(left.sparkSession.createDataFrame(hot, f"`{key}` {left.schema[key].dataType.simpleString()}, _salts bigint"))
    spread = left.join(salts, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    copies = right.join(salts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return spread.join(copies, [key, "_salt"], how).drop("_salt")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that it need not be installed or on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="graphloom-package-")) / "graphloom.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
