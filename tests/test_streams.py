"""Streams against the same work over a whole table."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from repolens.operators.findings import all_findings, dedup_findings
from repolens.sources import events as EV
from repolens.operators.sessions import activity_sessions, activity_sessions_stream
from repolens.streaming import folds, incremental, late, timers
from repolens.streaming.run import first_of_each, last_update, refold

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def parts(spark, tmp_path):
    """Writes a frame as ordered files, so that each becomes a micro-batch."""

    def write(df, by, n, name="in"):
        path = str(tmp_path / name)
        low, high = df.agg(F.min(by), F.max(by)).first()
        step = (high - low) // n + 1
        for i in range(n):
            part = df.where((F.col(by) >= low + i * step) & (F.col(by) < low + (i + 1) * step))
            part.coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return write


def run(writer, tmp_path, name):
    query = writer.option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None and not query.isActive


def to_memory(spark, sdf, tmp_path, name, mode):
    run(sdf.writeStream.format("memory").queryName(name).outputMode(mode), tmp_path, name)
    return spark.table(name)


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def events(spark):
    return spark.range(600).select(
        F.concat(F.lit("job"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17)).alias("job_id"),
        F.col("id").alias("seq"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 10).alias("ts"),
        F.element_at(F.array(*map(F.lit, ["progress", "issue_found", "output", "progress", "issue_found", "done", "error"])),
                     (F.pmod(F.xxhash64("id"), F.lit(7)) + 1).cast("int")).alias("event"),
        (F.col("id") % 100).cast("int").alias("pct"), F.concat(F.lit("m"), "id").alias("message"))


def test_progress(spark, events, parts, tmp_path):
    sdf = parts(events, "seq", 4)
    rows = to_memory(spark, folds.progress_fold(sdf), tmp_path, "progress", "complete")
    assert as_set(rows) == as_set(folds.progress_fold(events))


def test_progress_of_single_jobs(spark):
    rows = [("a", 1, "issue_found", None, None), ("b", 1, "progress", 15, "scan"), ("b", 2, "progress", 35, "tests"), ("b", 3, "error", None, "bad"),
            ("c", 1, "progress", 90, "x"), ("c", 2, "done", None, None)]
    df = spark.createDataFrame(rows, "job_id string, seq long, event string, pct int, message string").withColumn("ts", F.timestamp_seconds("seq"))
    got = {r.job_id: tuple(r)[1:] for r in folds.progress_fold(df).collect()}
    assert got == {"a": (5, "Starting analysis\u2026", 1, True, None), "b": (35, "tests", 0, False, "bad"), "c": (100, "Analysis complete!", 0, False, None)}


@pytest.fixture
def fix_events(events):
    kind = F.when(F.col("event") == "done", "fix_complete").when(F.col("event") == "error", "fix_failed").otherwise("output")
    return events.withColumn("event", F.when(F.col("seq") < 120, "output").otherwise(kind)).withColumn("diff", F.concat(F.lit("d"), "seq"))


@pytest.mark.parametrize("order", ["seq", "dealt"])
def test_fix_jobs(spark, fix_events, parts, order):
    """The last row of each job is that of the fold over the whole table, whatever the order of arrival."""
    sdf = parts(fix_events.withColumn("dealt", F.pmod(F.xxhash64("seq"), F.lit(1000))), order, 6)
    rows = last_update(folds.fix_fold_stream(sdf), "job_id")
    assert as_set(rows) == as_set(folds.fix_fold(fix_events))


def test_timeouts(spark, parts, tmp_path):
    times = {"ok": [(0, "progress"), (100, "done")], "late": [(0, "progress"), (123, "done")], "never": [(5, "progress"), (300, "output")],
             "edge": [(10, "progress"), (132, "error")], "end": [(100_000, "progress"), (100_010, "done")]}
    rows = [(j, n, T0 + dt.timedelta(seconds=s), e) for j, es in times.items() for n, (s, e) in enumerate(es)]
    df = spark.createDataFrame(rows, "job_id string, seq long, ts timestamp, event string").withColumn("at", F.unix_timestamp("ts"))
    assert {r.job_id for r in folds.job_timeouts(df).where("timed_out").collect()} == {"late", "never"}


def test_timeout_waits(spark):
    """A job is judged by the clock: one with a fresh event is still running."""
    df = spark.createDataFrame([("new", T0, "progress"), ("old", T0 - dt.timedelta(seconds=123), "progress")], "job_id string, ts timestamp, event string")
    assert {r.job_id: r.timed_out for r in folds.job_timeouts(df).collect()} == {"new": False, "old": True}
    later = folds.job_timeouts(df, now=F.lit(T0 + dt.timedelta(seconds=123)))
    assert later.where("timed_out").count() == 2
    assert folds.job_timeouts(df.limit(0)).count() == 0


def arrive(spark, tmp_path, arrivals, schema, start):
    """Runs a stream up to each of several arrivals, each time from its checkpoint."""
    for rows in arrivals:
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        query = start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    return query


def test_timers(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    arrivals = [
        [("ok", at(0), "progress"), ("late", at(0), "progress"), ("never", at(5), "progress"), (None, at(1), "progress"), ("dark", None, "progress")],
        [("ok", at(100), "done"), ("late", at(130), "done"), ("early", at(60), "progress"), ("early", at(20), "progress")],
        # No further event of the others: the clock is moved by this job alone.
        [("clock", at(500), "progress")], [("clock", at(501), "done"), ("never", at(502), "output")],
        [("end", at(10_000), "progress")],
    ]

    def start(events):
        out = timers.job_timeouts_stream(events, delay="0 seconds", remember_seconds=600)
        return out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")

    query = arrive(spark, tmp_path, arrivals, "job_id string, ts timestamp, event string", start)
    got = sorted((r.job_id, r.started) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("early", at(20)), ("late", at(0)), ("never", at(5))]
    # Settled jobs are forgotten after a while: what is left is the last one.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_late_rows(spark, tmp_path):
    at = lambda m: None if m is None else T0 + dt.timedelta(minutes=m)
    minutes = [[0, 5, 3], [20, 9, None], [9, 10, 11, 30], [], [19, 20, 100], [89, 91]]
    arrivals = [[(i * 10 + j, at(m)) for j, m in enumerate(ms)] for i, ms in enumerate(minutes) if ms]
    query = arrive(spark, tmp_path, arrivals, "id int, ts timestamp", lambda rows: late.split_late(rows, f"{tmp_path}/out", f"{tmp_path}/ck"))
    assert query.lastProgress is not None
    on_time, behind = late.read_split(spark, f"{tmp_path}/out", spark.createDataFrame([], "id int, ts timestamp").schema)
    assert sorted(r.id for r in behind.collect()) == [20, 40, 50]
    assert on_time.count() + behind.count() == sum(map(len, minutes))


@pytest.mark.parametrize("slice_seconds", [7, 60, 10**6])
def test_sessions(spark, slice_seconds):
    times = {"a": [0, 5, 9, 19, 40, 41], "b": [100], "c": [0, 10, 20, 30.000001, 39.999999], "d": [3, 3, 3]}
    rows = [(j, T0 + dt.timedelta(seconds=s)) for j, ss in times.items() for s in ss] + [("e", None), (None, T0)]
    got = activity_sessions(spark.createDataFrame(rows, "job_id string, ts timestamp"), gap_seconds=10, slice_seconds=slice_seconds)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    want = [("a", at(0), at(19), 4), ("a", at(40), at(41), 2), ("b", at(100), at(100), 1), ("d", at(3), at(3), 3), (None, T0, T0, 1)]
    want += [("c", at(0), at(20), 3), ("c", at(30.000001), at(39.999999), 2)]
    assert as_set(got) == sorted(want, key=repr)


def test_sessions_as_they_close(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    arrivals = [[("a", at(0)), ("b", at(2))], [("a", at(9)), ("a", at(15))], [("b", at(40))], [("b", at(45)), ("c", at(60))]]

    def start(events):
        out = activity_sessions_stream(events, gap_seconds=10, delay="0 seconds")
        return out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")

    arrive(spark, tmp_path, arrivals, "job_id string, ts timestamp", start)
    assert as_set(spark.read.parquet(f"{tmp_path}/out")) == [("a", at(0), at(15), 3), ("b", at(2), at(2), 1), ("b", at(40), at(45), 2)]


def test_reading_is_bounded_by_the_buckets_touched(spark, parts):
    """Twenty micro-batches of one key each: none reads what other keys have stored."""
    df = spark.range(200).selectExpr("id", "cast(floor(id / 10) as string) as k", "id as n")
    read = []

    def fold(stored):
        read.append(len(stored.inputFiles()))
        return stored.groupBy("k").agg(F.sum("n").alias("n"))

    out = refold(parts(df, "id", 20), "k", fold, "bounded", buckets=64)
    assert as_set(out.drop("batch")) == as_set(df.groupBy("k").agg(F.sum("n").alias("n")))
    # A batch's own rows, and those of the few keys that share its bucket; not the 20 folders there are.
    assert len(read) == 21 and max(read) <= 8
    twice = df.unionByName(df.withColumn("id", F.col("id") + 200))
    assert as_set(first_of_each(parts(twice, "id", 20, "twice"), ["k", "n"], "once").select("k", "n")) == as_set(df.select("k", "n"))


def test_last_version_in_a_micro_batch(spark, parts, tmp_path):
    """Of two versions that come together the last one counts, whatever order they are stored in."""
    rows = [(2, "r", "a.js", "x\n"), (1, "r", "a.js", "eval(x);\n"), (1, "r", "b.js", "x\n"), (2, "r", "b.js", "eval(x);\n"), (1, "r", "c.js", "eval(x);\n")]
    df = spark.createDataFrame(rows, "id long, repo_id string, path string, content string")
    out = str(tmp_path / "out")
    run(incremental.analyze_stream(parts(df, "id", 1), out, str(tmp_path / "ck-files"), order="id"), tmp_path, "files")
    assert sorted(r.file_path for r in incremental.stored_findings(spark, out).collect()) == ["b.js", "c.js"]


def test_live_counts(spark, parts, tmp_path):
    df = spark.range(200).select(F.col("id"), F.concat(F.lit("r"), F.col("id") % 3).alias("repo_id"),
                                 F.when(F.col("id") % 2 == 0, "low").otherwise("high").alias("severity"))
    rows = to_memory(spark, folds.live_counts(parts(df, "id", 3)), tmp_path, "live", "complete")
    assert as_set(rows) == as_set(folds.live_counts(df))


def test_stream_dedup(spark, parts, tmp_path):
    df = spark.range(100).select(
        F.col("id"), F.lit("run").alias("run_id"), F.lit("r").alias("repo_id"), F.concat(F.lit("f"), F.col("id") % 10).alias("file_path"),
        F.lit(1).alias("line_number"), F.lit("t").alias("title"), F.timestamp_seconds(F.col("id")).alias("ts"))
    far = df.withColumn("ts", F.timestamp_seconds(F.col("id") * 100_000)).withColumn("title", F.when(F.col("id") % 10 < 5, "t"))
    rows = folds.dedup_stream(parts(far, "id", 4))
    assert rows.count() == rows.dropDuplicates(["file_path"]).count() == 10


def test_messages(spark, tmp_path):
    folder = tmp_path / "messages"
    os.makedirs(folder)
    lines = [json.dumps({"event": "progress", "job_id": "j", "pct": 5, "message": "m", "ts": "2024-01-01T00:00:00Z"}),
             json.dumps({"event": "issue_found", "job_id": "j", "issue": {"id": "i", "severity": "low"}}), "plain text", '{"event": "done"} x',
             json.dumps({"event": "test_result", "repo_id": "r", "run_id": "t", "passed": True, "tests_total": 3, "tests_passed": 3, "tests_failed": 0}),
             json.dumps({"event": "fix_complete", "job_id": "k", "ts": "2024-01-01T00:00:01Z"})]
    (folder / "a.txt").write_text("\n".join(lines))
    events = EV.read_events(spark, str(folder))
    rows = to_memory(spark, events, tmp_path, "messages", "append")
    got = sorted((r.event, r.line) for r in rows.collect())
    assert got == sorted([("progress", None), ("issue_found", None), ("raw", "plain text"), ("raw", '{"event": "done"} x'), ("test_result", None),
                          ("fix_complete", None)])
    assert rows.where("event = 'issue_found'").first().issue.severity == "low"
    results = to_memory(spark, folds.test_results(EV.read_events(spark, str(folder))), tmp_path, "results", "append").collect()
    assert [(r.run_id, r.tests_passed, r.passed) for r in results] == [("t", 3, True)]
    jobs = spark.createDataFrame([("k", "i7"), ("z", "i8")], "job_id string, issue_id string")
    updates = to_memory(spark, folds.issue_updates(EV.read_events(spark, str(folder)), jobs), tmp_path, "updates", "append").collect()
    assert [(r.issue_id, r.status) for r in updates] == [("i7", "fixed")]
    out = str(tmp_path / "stored")
    run(EV.write_events(EV.read_events(spark, str(folder)), out, str(tmp_path / "ck-store"), buckets=8), tmp_path, "store")
    assert [r.event for r in EV.read_job_events(spark, out, "k", buckets=8).collect()] == ["fix_complete"]
    assert spark.read.parquet(out).count() == 6


def test_files_as_they_arrive(spark, parts, tmp_path):
    sources = ["import os\n", "def f(): pass\ndef lonely(): pass\n", "eval(x)\n", "def test_f(): pass\n", "def (\n", 'API_KEY = "abcdef"\n', "import sys\nsys\n"]
    rows = [(i, f"r{i % 4}", ("test_" if "test_" in s else "") + f"m{i % 14}.py", s) for i, s in ((i, sources[i % 7]) for i in range(42))]
    rows += [(42 + i, f"r{i % 4}", f"w{i}.js", "el.innerHTML = 1\n") for i in range(6)]
    # File 0 of r0 arrives again, clean; script w0 of r0 too.
    rows += [(100, "r0", "m0.py", "x = 1\n"), (101, "r0", "w0.js", "x\n")]
    df = spark.createDataFrame(rows, "id long, repo_id string, path string, content string")
    last = df.groupBy("repo_id", "path").agg(F.max_by("content", "id").alias("content"))
    sdf = parts(df, "id", 3)
    out = str(tmp_path / "out")
    run(incremental.analyze_stream(sdf.drop("id"), out, str(tmp_path / "ck-files")), tmp_path, "files")
    columns = ["repo_id", "file_path", "line_number", "title", "evidence"]
    whole = dedup_findings(all_findings(last)).select(columns)
    assert as_set(incremental.stored_findings(spark, out).select(columns)) == as_set(whole)
    assert whole.where("title like 'No Test%'").count() > 0
