"""Processing only new or changed records: a high watermark on the commit sequence with a transactional commit log.

A run fixes what it covers when it starts: the list of the source's files that no earlier run has read (or, for a source without
files, the latest receipt time). What those hold is staged once; selection, output and next watermark are all derived from the
stage, so nothing that arrives meanwhile can be counted as seen. A record above its project's watermark is new; one at or below
it is late or a repetition, which the ids decided so far tell apart. Output, decided ids, file list and watermark are published
together by creating one manifest file, which fails if another run has created it. Whatever a failed run left behind is never
named by a manifest and therefore never read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Commits may be abbreviated to this many characters and no fewer.
SHORT_COMMIT = 10


def instant(text: F.Column) -> F.Column:
    """ISO-8601 text as an instant; text without an offset is UTC, unreadable text is null."""
    zoned = F.when(text.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def as_instant(df: DataFrame, name: str) -> F.Column:
    """A timestamp column as an instant; one without zone is read as UTC, whatever the session's zone."""
    zoneless = dict(df.dtypes)[name] == "timestamp_ntz"
    if zoneless and df.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        return F.concat(F.col(name).cast("string"), F.lit("Z")).cast("timestamp")
    return F.col(name).cast("timestamp")


def last_successful_runs(runs: DataFrame) -> DataFrame:
    """(project_slug, run_id, commit, run_started): of the runs with status ``ok``, a commit and a readable ``indexed_at``, the latest per project.

    Blank commits and unreadable or null ``indexed_at`` make a run unsuccessful; equal instants go to the larger run_id; runs
    without a project are ignored; repeated rows do no harm.
    """
    good = runs.select(
        "project_slug",
        "run_id",
        F.lower(F.trim("last_indexed_commit")).alias("commit"),
        as_instant(runs, "started_at").alias("run_started"),
        instant(F.trim("indexed_at")).alias("done"),
        "run_status",
    ).where("run_status = 'ok' AND commit <> '' AND done IS NOT NULL AND project_slug IS NOT NULL")
    best = F.max(F.struct("done", "run_id", "commit", "run_started")).alias("r")
    return good.groupBy("project_slug").agg(best).select("project_slug", "r.run_id", "r.commit", "r.run_started")


def watermarks(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """(project_slug, run_id, wm_commit_no, wm_started): how far each project is covered.

    The commit is looked up among the project's own commits, regardless of case, in full or by at least ten leading characters.
    Projects whose last commit is unknown have no row. An abbreviation that fits several commits takes the lowest, so that
    nothing is skipped.
    """
    commits = (
        changes.select("project_slug", F.lower("commit_sha").alias("sha"), "commit_no")
        .where(f"project_slug IS NOT NULL AND commit_no IS NOT NULL AND length(sha) >= {SHORT_COMMIT}")
        .groupBy("project_slug", "sha")
        .agg(F.min("commit_no").alias("commit_no"))
        .withColumn("short", F.substring("sha", 1, SHORT_COMMIT))
    )
    last = last_successful_runs(runs).where(f"length(commit) >= {SHORT_COMMIT}").withColumn("short", F.substring("commit", 1, SHORT_COMMIT))
    return (
        last.join(commits, ["project_slug", "short"])
        .where(F.col("sha").startswith(F.col("commit")))
        .groupBy("project_slug")
        .agg(F.max("run_id").alias("run_id"), F.min("commit_no").alias("wm_commit_no"), F.max("run_started").alias("wm_started"))
    )


def first_deliveries(changes: DataFrame) -> DataFrame:
    """One row per change with its first ``received_at`` as ``first_received``; ``own`` identifies rows without a change_id by their content.

    Repeated deliveries of a change_id are merged by a partial aggregation before any shuffle, so a change delivered millions
    of times costs no more than one.
    """
    own = F.when(F.col("change_id").isNull(), F.sha2(F.to_json(F.struct("project_slug", "commit_sha", "file_path", "content_sha")), 256)).alias("own")
    rows = changes.select("change_id", own, "project_slug", "commit_no", as_instant(changes, "received_at").alias("received"))
    return rows.groupBy("change_id", "own").agg(F.min("project_slug").alias("project_slug"), F.max("commit_no").alias("commit_no"), F.min("received").alias("first_received"))


def is_covered() -> F.Column:
    return F.coalesce(F.expr("commit_no <= wm_commit_no AND first_received <= wm_started"), F.lit(False))


def pending_changes(changes: DataFrame, marks: DataFrame) -> DataFrame:
    """Changes the watermarks do not cover: (change_id, project_slug, commit_no, first_received).

    Covered means commit_no <= wm_commit_no and first_received <= wm_started. A late record below the watermark, a change
    without commit number or receipt time, and every change of a project without watermark are pending.
    """
    return first_deliveries(changes).join(marks, "project_slug", "left").where(~is_covered()).select("change_id", "project_slug", "commit_no", "first_received")


def upper_bound(changes: DataFrame) -> int | None:
    """The latest receipt time there is when the run starts, in microseconds; None if there is none."""
    return changes.select(as_instant(changes, "received_at").alias("r")).agg(F.unix_micros(F.max("r")).alias("u")).first()["u"]


class FileSource:
    """A folder of Parquet files that are added and never rewritten; a run reads the files no run before it has read."""

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None):
        self.spark, self.path, self.schema = spark, path, schema

    def _read(self, *paths: str) -> DataFrame:
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(*paths)

    def files(self) -> list[str]:
        return sorted(unquote(f) for f in self._read(self.path).inputFiles())

    def read(self, files: list[str]) -> DataFrame:
        return self._read(*files) if files else self._read(self.path).limit(0)


@dataclass(frozen=True)
class Commit:
    """A published run: its number, the folders of its output and of the watermark after it, and those of all ids decided and files read so far."""

    seq: int
    output: str
    watermark: str
    decided: list[str] = field(default_factory=list)
    listing: list[str] = field(default_factory=list)


#: File systems on which no file can be created under the condition that it does not exist, as far as this log knows.
WITHOUT_CREATION = ("s3", "s3a", "s3n", "gs", "wasb", "wasbs", "oss", "cosn")


class CommitLog:
    """Manifests ``<root>/_commits/<seq>.json``; the newest one is the state.

    The root must lie on a file system that creates a name only if it is free: a local disk (a hard link) or one of the HDFS
    kind (a rename that does not overwrite, which is also what a disk without links gets, there without the guarantee). Object
    stores are refused.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._scheme = self._fs.getUri().getScheme()
        if self._scheme in WITHOUT_CREATION:
            raise ValueError(f"a commit log needs conditional creation, which {self._scheme} does not promise")

    def _names(self) -> list[str]:
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        return sorted(s.getPath().toString() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def _load(self, name: str) -> Commit:
        stream = self._fs.open(self._path(name))
        try:
            return Commit(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def commits(self) -> list[Commit]:
        return [self._load(name) for name in self._names()]

    def last(self) -> Commit | None:
        """The state; only the newest manifest is read."""
        names = self._names()
        return self._load(names[-1]) if names else None

    @staticmethod
    def _linked(aside: str, target: str) -> bool:
        """Whether the name was given by a hard link; False where the disk knows none, FileExistsError if the name is taken."""
        try:
            os.link(aside, target)
            return True
        except FileExistsError:
            raise
        except OSError:
            return False

    def publish(self, commit: Commit) -> None:
        """Write the manifest aside, then give it its name in one step that fails if the name is taken."""
        target, aside = f"{self.root}/_commits/{commit.seq:012d}.json", f"{self.root}/_staging/{uuid.uuid4().hex}.json"
        self._fs.mkdirs(self._path(target).getParent())
        stream = self._fs.create(self._path(aside), False)
        stream.write(bytearray(json.dumps(commit.__dict__).encode()))
        stream.close()
        try:
            if self._scheme != "file" or not self._linked(urlparse(aside).path, urlparse(target).path):
                jvm = self.spark.sparkContext._jvm
                never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(aside), self._path(target), never)
        except Exception as e:
            if isinstance(e, FileExistsError) or self._fs.exists(self._path(target)):
                raise RuntimeError(f"commit {commit.seq} was published by another run") from e
            raise
        finally:
            self._fs.delete(self._path(aside), False)


#: Folders a state names before they are merged into one.
COMPACT_AFTER = 16


def _state(spark: SparkSession, before: list[str], now: str, merged: str) -> list[str]:
    """The folders of a growing table after one more of them; many are merged into one."""
    folders = [*before, now]
    if len(folders) <= COMPACT_AFTER:
        return folders
    spark.read.parquet(*folders).write.parquet(merged)
    return [merged]


def _not_decided(arrived: DataFrame, last: Commit) -> DataFrame:
    """What of the stage no run has decided about. Only what lies at or below its project's watermark can have been, and only
    ids decided within the commit numbers of that are read."""
    spark = arrived.sparkSession
    tops = spark.read.parquet(last.watermark).select("project_slug", "wm_commit_no")
    marked = arrived.join(tops, "project_slug", "left")
    above = F.coalesce(F.col("commit_no") > F.coalesce("wm_commit_no", F.lit(-(1 << 31))), F.lit(False)) & F.col("project_slug").isNotNull()
    late = marked.where(~above)
    span = late.agg(F.min("commit_no").alias("lo"), F.max("commit_no").alias("hi"), F.count_if(F.col("commit_no").isNull()).alias("none"), F.count("*").alias("n")).first()
    if not span["n"]:
        return marked.drop("wm_commit_no")
    known = spark.read.parquet(*last.decided)
    within = F.col("commit_no").between(span["lo"], span["hi"]) if span["lo"] is not None else F.lit(False)
    known = known.where(within | F.col("commit_no").isNull() if span["none"] else within)
    known = known.select(F.col("change_id").alias("k_id"), F.col("own").alias("k_own")).distinct()
    new = late.join(known, F.col("change_id").eqNullSafe(F.col("k_id")) & F.col("own").eqNullSafe(F.col("k_own")), "left_anti")
    return marked.where(above).unionByName(new).drop("wm_commit_no")


def incremental_run(
    changes: DataFrame | FileSource,
    log: CommitLog,
    seed: Callable[[], DataFrame] | None = None,
    process: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Commit:
    """One run: watermark in, bounded selection, output and next watermark out, all published at once.

    ``seed`` gives the watermarks when the log is empty (default: none, everything is new); what they cover is recorded as
    decided and never output. Every change is decided once, by its id (rows without an id by their content), whenever it becomes
    visible and whatever its times say; a change keeps its commit number, or a delivery with another one counts as another
    change where it lies above the watermark. The next watermark of a project is its highest commit number decided on. A crash
    at any point before ``publish`` leaves the log as it was, so the next run does the same work again. A DataFrame is read
    whole, up to the latest receipt time there is at the start; of a FileSource only new files are read.
    """
    last = log.last()
    seq = last.seq + 1 if last else 1
    folder = f"{log.root}/run-{seq:012d}-{uuid.uuid4().hex}"
    spark = log.spark
    listing = list(last.listing) if last else []
    if isinstance(changes, FileSource):
        files = changes.files()  # fixed from here on
        if listing:
            files = sorted(set(files) - {r["file"] for r in spark.read.parquet(*listing).collect()})  # as many as the source has files
        rows = first_deliveries(changes.read(files))
        spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.parquet(f"{folder}/listing")
        listing = _state(spark, listing, f"{folder}/listing", f"{folder}/all-listings")
    else:
        upper = upper_bound(changes)  # fixed from here on
        rows = first_deliveries(changes)
        if upper is not None:
            rows = rows.where(F.col("first_received").isNull() | (F.unix_micros("first_received") <= upper))
    rows.write.parquet(f"{folder}/arrived")
    arrived = spark.read.parquet(f"{folder}/arrived")
    if last:
        decided = _not_decided(arrived, last).withColumn("covered", F.lit(False))
    elif seed:
        decided = arrived.join(seed(), "project_slug", "left").withColumn("covered", is_covered())
    else:
        decided = arrived.withColumn("covered", F.lit(False))
    decided.select("change_id", "own", "project_slug", "commit_no", "first_received", "covered").sortWithinPartitions("commit_no").write.parquet(f"{folder}/decided")
    decided = spark.read.parquet(f"{folder}/decided")
    process(decided.where("NOT covered").select("change_id", "project_slug", "commit_no", "first_received")).write.parquet(f"{folder}/output")
    tops = decided.where("project_slug IS NOT NULL AND commit_no IS NOT NULL").select("project_slug", F.col("commit_no").alias("wm_commit_no"))
    if last:
        tops = tops.unionByName(spark.read.parquet(last.watermark))
    tops.groupBy("project_slug").agg(F.max("wm_commit_no").alias("wm_commit_no")).write.parquet(f"{folder}/watermark")
    ids = _state(spark, last.decided if last else [], f"{folder}/decided", f"{folder}/all-decided")
    commit = Commit(seq, f"{folder}/output", f"{folder}/watermark", ids, listing)
    log.publish(commit)
    return commit


def committed_output(spark: SparkSession, log: CommitLog) -> DataFrame | None:
    """Everything published so far; None before the first commit."""
    paths = [c.output for c in log.commits()]
    return spark.read.parquet(*paths) if paths else None
