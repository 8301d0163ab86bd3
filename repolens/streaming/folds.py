"""State of jobs folded from their events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.operators.lifecycle import moment
from repolens.streaming.run import BUCKETS, first_of_each, refold

# State before the first event, and after the last.
START_PCT, START_MESSAGE = 5, "Starting analysis\u2026"
DONE_PCT, DONE_MESSAGE = 100, "Analysis complete!"


def progress_fold(events: DataFrame) -> DataFrame:
    """``(job_id, pct, message, issues, running, error)`` of analysis jobs.

    The last progress or done event gives percentage and message, the last error its text; any of
    done and error ends the job. Only mergeable aggregates are used, so this one function serves a
    table and, in update mode, a stream, whatever the order of arrival.
    """
    event = F.col("event")
    at = ["ts", "seq"]
    shown = F.max(F.when(event.isin("progress", "done"), F.struct(
        *at,
        F.when(event == "done", F.lit(DONE_PCT)).otherwise(F.col("pct")).alias("pct"),
        F.when(event == "done", F.lit(DONE_MESSAGE)).otherwise(F.col("message")).alias("message"),
    )))
    failed = F.max(F.when(event == "error", F.struct(*at, "message")))
    state = events.groupBy("job_id").agg(
        shown.alias("p"),
        F.count_if(event == "issue_found").alias("issues"),
        F.bool_or(event.isin("done", "error")).alias("ended"),
        failed.alias("e"),
    )
    return state.select(
        "job_id",
        F.coalesce("p.pct", F.lit(START_PCT)).cast("int").alias("pct"),
        F.coalesce("p.message", F.lit(START_MESSAGE)).alias("message"),
        "issues",
        (~F.col("ended")).alias("running"),
        F.col("e.message").alias("error"),
    )


def fix_fold(events: DataFrame) -> DataFrame:
    """``(job_id, status, lines, diff, error)`` of fix jobs.

    Output lines make a job running; the first ``fix_complete`` or ``fix_failed`` ends it, and what
    comes after that does not count.
    """
    ends = events.where(F.col("event").isin("fix_complete", "fix_failed"))
    # The end is found by its moment; diff and message are fetched for the events that are one.
    first = ends.groupBy("job_id").agg(F.min(moment()).alias("end"))
    ended = ends.withColumn("end", moment()).join(first, ["job_id", "end"], "left_semi")
    ended = ended.select("job_id", F.col("event").alias("how"), "diff", "message").distinct()
    rows = events.select("job_id", "event", moment().alias("at")).join(first, "job_id", "left")
    counted = (F.col("event") == "output") & (F.col("end").isNull() | (F.col("at") < F.col("end")))
    lines = rows.groupBy("job_id").agg(F.count_if(counted).alias("lines"))
    complete = F.col("how") == "fix_complete"
    return lines.join(ended, "job_id", "left").select(
        "job_id",
        F.when(complete, F.lit("succeeded"))
        .when(F.col("how").isNotNull(), F.lit("failed"))
        .when(F.col("lines") > 0, F.lit("running"))
        .otherwise(F.lit("pending"))
        .alias("status"),
        "lines",
        F.when(complete, F.col("diff")).alias("diff"),
        F.when(~complete, F.col("message")).alias("error"),
    )


def job_timeouts(events: DataFrame, budget_seconds: int = K.JOB_BUDGET_SECONDS, now: Column | None = None) -> DataFrame:
    """``(job_id, started, timed_out)``: jobs with no done or error event within the budget, once that is over.

    ``now`` is the time to judge at; without it, that of the newest event. A job whose budget is not over yet
    has not timed out.
    """
    now = events.agg(F.max("ts")).scalar() if now is None else now
    ended = F.min(F.when(F.col("event").isin("done", "error"), F.col("ts")))
    jobs = events.groupBy("job_id").agg(F.min("ts").alias("started"), ended.alias("ended"))
    deadline = F.timestamp_add("SECOND", F.lit(budget_seconds), F.col("started"))
    late = (F.col("ended").isNull() | (F.col("ended") > deadline)) & (deadline < now)
    return jobs.select("job_id", "started", late.alias("timed_out"))


def fix_fold_stream(events: DataFrame, name: str = "fixes", buckets: int = BUCKETS) -> DataFrame:
    """:func:`fix_fold` of a stream after each micro-batch: the jobs it touches, over all their events so
    far. The outcome does not depend on the order of arrival, and no event is late."""
    rows = events.select("job_id", "ts", "seq", "event", "diff", "message")
    return refold(rows, "job_id", fix_fold, name, buckets)


def live_counts(issues: DataFrame) -> DataFrame:
    """Running issue counts by repository and severity; for tables and, in update mode, streams."""
    return issues.groupBy("repo_id", "severity").agg(F.count("*").alias("issues"))


def dedup_stream(findings: DataFrame, name: str = "dedup", buckets: int = BUCKETS) -> DataFrame:
    """Findings of a stream, each key once however far apart its copies arrive: the first one of the first
    micro-batch that has it."""
    return first_of_each(findings, ["run_id", "repo_id", "file_path", "line_number", "title"], name, buckets)


def test_results(events: DataFrame) -> DataFrame:
    """Rows for the table of test runs from ``test_result`` events."""
    return events.where(F.col("event") == "test_result").select(
        "run_id", "repo_id", F.col("fix_job_id").alias("job_id"), "passed", "tests_total", "tests_passed", "tests_failed",
        F.col("ts").alias("ran_at"),
    )


def issue_updates(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Status rows of issues whose fix completed: a stream of events against the table of jobs."""
    done = events.where(F.col("event") == "fix_complete").select("job_id", "ts", "seq")
    return done.join(jobs.select("job_id", "issue_id"), "job_id").select(
        "issue_id", "ts", "seq", F.lit("fixed").alias("status")
    )
