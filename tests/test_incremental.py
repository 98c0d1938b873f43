import datetime as dt
import random

import pytest

from graphloom.operators import incremental as I

CHANGES = "change_id bigint, project_slug string, commit_sha string, commit_no int, file_path string, content_sha string, received_at timestamp, extra string"
RUNS = "run_id bigint, project_slug string, run_status string, started_at timestamp, last_indexed_commit string, indexed_at string"


def at(h):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)


def sha(p, n):
    return f"{p}{n:03d}" + "ab" * 20


def change(i, p="p", n=1, h=1.0):
    return (i, p, sha(p, n)[:40], n, f"f{i}", "c", at(h), "x")


def ids(df):
    return sorted((r["change_id"] for r in df.collect()), key=lambda x: (x is None, x or 0))


def test_covered_needs_low_commit_and_early_receipt(spark):
    changes = spark.createDataFrame([change(1, n=1, h=1), change(2, n=2, h=1), change(3, n=3, h=1), change(4, n=1, h=9), change(4, n=1, h=20), change(5, n=1, h=9), change(5, n=1, h=2)], CHANGES)
    runs = spark.createDataFrame(
        [(1, "p", "ok", at(5), sha("p", 2)[:40].upper()[:12], "2025-01-01T06:00:00Z"), (2, "p", "failed", at(8), sha("p", 3)[:40], "2025-01-01T09:00:00Z"), (3, "p", "ok", at(8), None, "2025-01-01T09:00:00Z"), (4, "p", "ok", at(8), sha("p", 3)[:40], "nonsense")],
        RUNS,
    )
    assert ids(I.pending_changes(changes, I.watermarks(runs, changes))) == [3, 4]


def test_latest_run_is_by_instant_not_by_text(spark):
    changes = spark.createDataFrame([change(1, n=1), change(2, n=2), change(3, n=3)], CHANGES)
    runs = spark.createDataFrame([(1, "p", "ok", at(5), sha("p", 1)[:40], "2025-01-01T23:00:00+09:00"), (2, "p", "ok", at(5), sha("p", 2)[:40], "2025-01-01T15:00:00.5")], RUNS)
    assert ids(I.pending_changes(changes, I.watermarks(runs, changes))) == [3]


def test_unknown_short_or_foreign_commit_leaves_everything_pending(spark):
    changes = spark.createDataFrame([change(1), change(2, p="q"), (3, None, None, None, None, None, None, None)], CHANGES)
    runs = spark.createDataFrame([(1, "p", "ok", at(9), sha("p", 1)[:9], "2025-01-01T06:00:00Z"), (2, "q", "ok", at(9), sha("p", 1)[:40], "2025-01-01T06:00:00Z")], RUNS)
    assert ids(I.pending_changes(changes, I.watermarks(runs, changes))) == [1, 2, 3]


def test_empty_tables(spark):
    changes, runs = spark.createDataFrame([], CHANGES), spark.createDataFrame([], RUNS)
    assert ids(I.pending_changes(changes, I.watermarks(runs, changes))) == []


def test_runs_neither_skip_nor_repeat_through_failures(spark, tmp_path):
    rng = random.Random(3)
    log = I.CommitLog(spark, f"file://{tmp_path}/log")
    arrived, seen = [], []

    class Crash(Exception):
        pass

    def crash(df):
        df.write.parquet(f"{tmp_path}/half-{rng.random()}")
        raise Crash

    for step in range(4):
        new = [change(step * 10 + i, p=rng.choice("pq"), n=rng.randint(1, 9), h=step * 10 + rng.random() * 9) for i in range(6)]
        new.append((900 + step, None, None, None, None, None, at(step * 10), None))
        arrived += new
        changes = spark.createDataFrame(arrived + arrived[: step * 2], CHANGES)
        if step % 2:
            with pytest.raises(Crash):
                I.incremental_run(changes, log, process=crash)
        commit = I.incremental_run(changes, log, process=lambda df: df.select("change_id"))
        got = ids(spark.read.parquet(commit.output))
        assert got == sorted(r[0] for r in new)
        seen += got
    assert sorted(seen) == sorted(r[0] for r in arrived) == ids(I.committed_output(spark, log))
    assert [c.seq for c in log.commits()] == [1, 2, 3, 4]
    with pytest.raises(RuntimeError):
        log.publish(I.Commit(4, "a", "b"))


def test_late_visible_changes_and_only_new_files(spark, tmp_path):
    log = I.CommitLog(spark, f"file://{tmp_path}/log")
    source = I.FileSource(spark, str(tmp_path / "in dir"), CHANGES)
    (tmp_path / "in dir").mkdir()
    read = []
    source.read = lambda files, read_files=source.read: read.append(len(files)) or read_files(files)

    def arrive(*rows):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(source.path)
        return ids(spark.read.parquet(I.incremental_run(source, log, process=lambda df: df.select("change_id")).output))

    nameless = (None, "p", sha("p", 2)[:40], 2, "f", "c", at(2), "x")
    assert arrive(change(1, n=1, h=1), change(5, n=5, h=5)) == [1, 5]
    # Commit 3 becomes visible later, stamped in between; 1 and 5 are delivered again, late and early.
    assert arrive(change(3, n=3, h=3), change(1, n=1, h=9), change(5, n=5, h=0), nameless) == [3, None]
    assert arrive(change(3, n=3, h=1), nameless, change(6, n=6, h=2), change(7, p="q", n=1, h=1)) == [6, 7]
    assert ids(spark.read.parquet(I.incremental_run(source, log).output)) == []
    assert read == [1, 1, 1, 0]


@pytest.mark.parametrize("links", [True, False])
def test_a_number_is_published_once(spark, tmp_path, monkeypatch, links):
    if not links:
        monkeypatch.setattr(I.CommitLog, "_linked", staticmethod(lambda aside, target: False))
    log = I.CommitLog(spark, f"file://{tmp_path}/log")
    log.publish(I.Commit(1, "a", "b"))
    with pytest.raises(RuntimeError, match="another run"):
        log.publish(I.Commit(1, "c", "d"))
    assert log.last() == I.Commit(1, "a", "b") and len(log.commits()) == 1


def test_states_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "COMPACT_AFTER", 2)
    log = I.CommitLog(spark, f"file://{tmp_path}/log")
    for i in range(4):
        commit = I.incremental_run(spark.createDataFrame([change(j, n=j) for j in range(1, i + 2)], CHANGES), log)
        assert ids(spark.read.parquet(commit.output)) == [i + 1] and len(commit.decided) <= 2
    assert log.last().seq == 4 and len(log.commits()) == 4


def test_what_a_seed_covers_stays_covered(spark, tmp_path):
    log = I.CommitLog(spark, f"file://{tmp_path}/log")
    marks = spark.createDataFrame([("p", 1, 2, at(5))], "project_slug string, run_id bigint, wm_commit_no int, wm_started timestamp")
    first = I.incremental_run(spark.createDataFrame([change(1, n=1, h=1), change(2, n=3, h=1)], CHANGES), log, seed=lambda: marks)
    second = I.incremental_run(spark.createDataFrame([change(1, n=1, h=20), change(4, n=1, h=30)], CHANGES), log, seed=lambda: marks)
    assert [ids(spark.read.parquet(c.output)) for c in (first, second)] == [[2], [4]]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_without_zone_are_utc_in_any_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT timestamp_ntz'2025-03-09 02:30:00.123456' AS t")
        want = int(dt.datetime(2025, 3, 9, 2, 30, 0, 123456, tzinfo=dt.timezone.utc).timestamp() * 1e6)
        assert df.select(I.F.unix_micros(I.as_instant(df, "t")).alias("u")).first()["u"] == want
        texts = ["2025-03-09T02:30:00", "2025-03-09T02:30:00Z", "2025-03-08T21:30:00-05:00", "2025-03-09T11:30:00.000000+09:00", "nonsense", None]
        got = [r["u"] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(I.F.unix_micros(I.instant(I.F.col("x"))).alias("u")).collect()]
        assert got == [want - 123456] * 4 + [None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
