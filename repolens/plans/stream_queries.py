"""Streams over the given tables, run until all there is has been read.

Each must give what the same work gives over the whole table, so it has the same oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.operators.sessions import activity_sessions_stream
from repolens.plans import derived
from repolens.plans.registry import ORACLES, Tables, query
from repolens.sources.events import write_events
from repolens.streaming import folds, incremental, late, timers
from repolens.streaming.run import last_update, new_folder, run_available, to_files


ARRIVALS = 5


def _stream(t: Tables, statement: str, table: str, arrivals: int = 0) -> DataFrame:
    """A derived table as a stream of the files of the one table it comes from; with ``arrivals``, of so
    many files over which its rows are dealt by hash, one per micro-batch, so in no order of time."""
    path = f"{t.sf_dir.rstrip('/')}/{table}.parquet"
    rows = t.spark.read.parquet(path)
    view = f"{table}_stream"
    if arrivals:
        folder = new_folder(t.spark, "dealt")
        rows.repartition(arrivals, F.xxhash64(*rows.columns)).write.parquet(folder)
        stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    else:
        # A stream takes a folder or a pattern, not the path of one file.
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{path[:-1]}[t]")
    stream.createOrReplaceTempView(view)
    return t.spark.sql(statement.replace(f"${table}", view))


def _as(name: str):
    """Register a stream with the SQL of the query over the whole table."""

    def register(job):
        query()(job)
        ORACLES[job.__name__] = ORACLES[name]
        return job

    return register


@_as("progress_fold")
def stream_progress_fold(t: Tables) -> DataFrame:
    rows = to_files(folds.progress_fold(_stream(t, derived.EVENTS, "events")), "update", "progress")
    return last_update(rows, "job_id").fillna("-", ["error"])


@_as("fix_fold")
def stream_fix_fold(t: Tables) -> DataFrame:
    rows = folds.fix_fold_stream(_stream(t, derived.FIX_EVENTS, "events", ARRIVALS), buckets=8)
    return last_update(rows, "job_id").fillna("-", ["diff", "error"])


def _in_arrivals(t: Tables, arriving: DataFrame, start, folder: str) -> None:
    """Write the rows of each ``arrival`` in turn and run the stream that ``start`` makes of them up to there: a
    micro-batch per arrival, of any number of files, with a restart between."""
    rows = arriving.drop("arrival")
    for k in range(ARRIVALS):
        arriving.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{folder}/in")
        run_available(start(t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")))


def _by_time(t: Tables) -> DataFrame:
    """Events in arrivals of six days, none of them late."""
    return t.events.withColumn("arrival", F.least(F.lit(4), F.floor((F.day("ts") - 1) / 6)).cast("int"))


def _appended(t: Tables, work, name: str) -> DataFrame:
    """Rows that a stream in append mode puts out over arrivals in order of time."""
    folder, schema = new_folder(t.spark, name), []

    def start(events: DataFrame):
        out = work(events)
        schema.append(out.schema)
        return out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append")

    _in_arrivals(t, _by_time(t), start, folder)
    return t.spark.read.schema(schema[0]).parquet(f"{folder}/out")


@query("""
WITH s AS (SELECT job_id, min(ts) AS started, min(ts) FILTER (WHERE event IN ('done', 'error')) AS ended FROM {EVENTS} e GROUP BY job_id),
  n AS (SELECT max(ts) - INTERVAL 10 MINUTE AS now FROM {EVENTS} e)
SELECT job_id, started FROM s, n WHERE (ended IS NULL OR ended > started + INTERVAL 122 SECOND) AND now > started + INTERVAL 122 SECOND
""")
def stream_job_timeouts(t: Tables) -> DataFrame:
    """Jobs whose timer fired; jobs of a month are remembered for longer than that."""
    return _appended(t, lambda events: timers.job_timeouts_stream(events, remember_seconds=90 * 86_400), "timeouts")


@query("""
WITH g AS (SELECT job_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM {EVENTS} e WINDOW w AS (PARTITION BY job_id ORDER BY ts)),
  s AS (SELECT job_id, ts, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts) AS n FROM g),
  o AS (SELECT job_id, min(ts) AS first, max(ts) AS last, CAST(count(*) AS bigint) AS events FROM s GROUP BY job_id, n)
SELECT * FROM o WHERE last + INTERVAL 6 HOUR < (SELECT max(ts) - INTERVAL 10 MINUTE FROM {EVENTS} e)
""")
def stream_activity_sessions(t: Tables) -> DataFrame:
    """Sessions that are over by the clock of the stream."""
    return _appended(t, lambda events: activity_sessions_stream(events, gap_seconds=6 * 3600), "sessions")


@query("""
WITH a AS (SELECT * FROM {ARRIVING} a), m AS (SELECT arrival, max(ts) AS top FROM a GROUP BY arrival),
  w AS (SELECT m.arrival, max(b.top) AS mark FROM m JOIN m AS b ON b.arrival < m.arrival GROUP BY m.arrival)
SELECT job_id, seq, a.arrival, mark IS NOT NULL AND ts < mark - INTERVAL 10 MINUTE AS late FROM a LEFT JOIN w ON w.arrival = a.arrival
""")
def stream_late_events(t: Tables) -> DataFrame:
    """All events, those that came late from their own table."""
    folder, arriving = new_folder(t.spark, "late"), t.arriving
    _in_arrivals(t, arriving, lambda events: late.split_late(events, folder, f"{folder}/state"), folder)
    on_time, behind = late.read_split(t.spark, folder, arriving.drop("arrival").schema)
    rows = on_time.withColumn("late", F.lit(False)).unionByName(behind.withColumn("late", F.lit(True)))
    return rows.select("job_id", "seq", F.col("batch").cast("int").alias("arrival"), "late")


@query("SELECT job_id, seq, event, message FROM {EVENTS} e")
def stream_job_events(t: Tables) -> DataFrame:
    """Events stored by job as they arrive, and read back."""
    events = _stream(t, derived.EVENTS, "events", ARRIVALS)
    folder = new_folder(t.spark, "jobs")
    run_available(write_events(events, folder, f"{folder}-state", buckets=16))
    return t.spark.read.schema(events.schema).parquet(folder).select("job_id", "seq", "event", "message")


@query("""
SELECT run_id, repo_id, fix_job_id AS job_id, passed, tests_total, tests_passed, tests_failed FROM {TEST_EVENTS} e WHERE event = 'test_result'
""")
def stream_test_results(t: Tables) -> DataFrame:
    return to_files(folds.test_results(_stream(t, derived.TEST_EVENTS, "events", ARRIVALS)), "append", "results").drop("ran_at", "batch")


@query("""
SELECT j.issue_id, e.seq, 'fixed' AS status FROM {FIX_EVENTS} e JOIN {FIXING} j ON j.job_id = e.job_id WHERE e.event = 'fix_complete'
""")
def stream_issue_updates(t: Tables) -> DataFrame:
    """Status rows of issues as their fixes complete."""
    updates = folds.issue_updates(_stream(t, derived.FIX_EVENTS, "events", ARRIVALS), t.fixing)
    return to_files(updates, "append", "updates").drop("ts", "batch")


@_as("live_counts")
def stream_live_counts(t: Tables) -> DataFrame:
    """Only counts that change are put out; the last of each holds."""
    rows = to_files(folds.live_counts(_stream(t, derived.ISSUES, "orders", ARRIVALS)), "update", "counts")
    last = rows.groupBy("repo_id", "severity").agg(F.max("issues").alias("issues"))
    return last


@query("SELECT DISTINCT 'run' AS run_id, repo_id, file_path, line_number, title FROM {FINDINGS} f")
def stream_dedup(t: Tables) -> DataFrame:
    """Every finding arrives twice, in any order and any distance."""
    found = _stream(t, derived.ISSUES, "orders", ARRIVALS).withColumn("run_id", F.lit("run"))
    twice = found.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return folds.dedup_stream(twice, buckets=8).select("run_id", "repo_id", "file_path", "line_number", "title")


@_as("all_findings")
def stream_findings(t: Tables) -> DataFrame:
    """Files analysed as they arrive; missing tests from the stored facts."""
    folder = new_folder(t.spark, "arrivals")
    run_available(incremental.analyze_stream(_stream(t, derived.CORPUS, "documents"), folder, f"{folder}/state"))
    return incremental.stored_findings(t.spark, folder).select(
        "repo_id", "file_path", "line_number", "category", "severity", "title", "evidence"
    )
