"""Fix jobs and test runs."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.functions.logs import parse_test_log
from repolens.functions.text import not_blank
from repolens.operators.enrich import with_fix_prompt
from repolens.operators.issues import gate_approve
from repolens.operators.skew import first_rows, ordinal


# Stands for a missing time: earlier than all others.
_NO_TIME = datetime.datetime(1, 1, 1)


def parse_runs(logs: DataFrame) -> DataFrame:
    """Adds the counts of the log in ``output``, and ``passed`` unless it is there already.

    Without an exit code a run counts as passed if tests ran and none failed.
    """
    rows = logs.withColumn("_log", parse_test_log(F.col("output"))).withColumns({
        "tests_total": F.col("_log.total"),
        "tests_passed": F.col("_log.passed"),
        "tests_failed": F.col("_log.failed"),
    }).drop("_log")
    if "passed" not in logs.columns:
        rows = rows.withColumn("passed", (F.col("tests_total") > 0) & (F.col("tests_failed") == 0))
    return rows


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each repository with all its columns; equal times go by id, a run without a time
    comes before all others.

    The run is picked on narrow columns, so no task sorts logs; the logs of the runs that were picked are
    fetched by id afterwards.
    """
    return _fetch(runs, _end(runs, F.max))


def _end(runs: DataFrame, pick) -> DataFrame:
    """``(_repo, _at, _run)``: the first or last run by time, then by id."""
    at = runs.groupBy("repo_id").agg(pick(F.coalesce("ran_at", F.lit(_NO_TIME))).alias("_at"))
    ties = runs.select(F.col("repo_id").alias("_repo"), F.coalesce("ran_at", F.lit(_NO_TIME)).alias("_when"), "run_id")
    ties = ties.join(at, F.col("_repo").eqNullSafe(F.col("repo_id")) & (F.col("_when") == F.col("_at")))
    return ties.groupBy("_repo", "_at").agg(pick("run_id").alias("_run"))


def _fetch(runs: DataFrame, ends: DataFrame) -> DataFrame:
    same = F.col("repo_id").eqNullSafe(F.col("_repo")) & F.col("run_id").eqNullSafe(F.col("_run"))
    return runs.join(ends, same & (F.coalesce("ran_at", F.lit(_NO_TIME)) == F.col("_at")), "left_semi")


def first_vs_latest_run(runs: DataFrame) -> DataFrame:
    """Oldest and newest run; the oldest is null if there is only one run. Takes raw logs."""
    def parsed(pick, name: str) -> DataFrame:
        end = _fetch(runs, _end(runs, pick)).withColumn("log", parse_test_log(F.col("output")))
        counts = [F.col(f"log.{c}").alias(f"{name}_tests_{c}") for c in ("passed", "failed")]
        return end.select(F.col("repo_id").alias(f"_{name}"), F.col("run_id").alias(f"{name}_run_id"), *counts)

    counts = runs.groupBy("repo_id").agg(F.count("*").alias("runs"))
    several = counts.where("runs > 1").select("repo_id")
    first = parsed(F.min, "first").join(several, F.col("_first").eqNullSafe(F.col("repo_id")), "left_semi")
    rows = counts.join(parsed(F.max, "latest"), F.col("repo_id").eqNullSafe(F.col("_latest")))
    return rows.join(first, F.col("repo_id").eqNullSafe(F.col("_first")), "left").select(
        "repo_id", "runs", *[f"{e}_{c}" for e in ("first", "latest") for c in ("run_id", "tests_passed", "tests_failed")]
    )


def runs_newest_first(runs: DataFrame) -> DataFrame:
    """Adds ``position`` within the repository, newest run first."""
    return ordinal(runs, ["repo_id"], [F.desc("ran_at"), F.desc("run_id")], "position")


def runs_with_jobs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every run, with issue and status of its job if it has one."""
    side = jobs.select("job_id", "issue_id", F.col("status").alias("job_status"))
    return runs.join(side, "job_id", "left")


def job_context(jobs: DataFrame, issues: DataFrame, repos: DataFrame) -> DataFrame:
    """Jobs with their issue and repository; a job that lacks either is left out."""
    issue = issues.select("issue_id", "title", "severity", "file_path", "line_number")
    repo = repos.select("repo_id", F.col("name").alias("repo_name"))
    return jobs.join(issue, "issue_id").join(repo, "repo_id")


def job_outcome(diff: Column) -> Column:
    """A job succeeded if its diff has any text."""
    return F.when(not_blank(diff), F.lit("succeeded")).otherwise(F.lit("failed"))


def issue_status_after_jobs(issues: DataFrame, jobs: DataFrame) -> DataFrame:
    """Issues with a succeeded job become fixed, others keep their status."""
    done = jobs.where(F.col("status") == "succeeded").select("issue_id").distinct().withColumn("_done", F.lit(True))
    rows = issues.join(done, "issue_id", "left")
    return rows.withColumn("status", F.when(F.col("_done"), F.lit("fixed")).otherwise(F.col("status"))).drop("_done")


def job_output(events: DataFrame) -> DataFrame:
    """``(job_id, position, line)``: the output of each job, a row per line, in order of ``seq`` from 1.

    One row per line holds for a job of any length; its text is the lines joined by newlines.
    """
    lines = events.where(F.col("event") == "output").select("job_id", "seq", F.col("message").alias("line"))
    return ordinal(lines, ["job_id"], ["seq"], "position").drop("seq")


def diffs_in_order(jobs: DataFrame) -> DataFrame:
    """``(repo_id, position, job_id, completed_at, diff)``: all diffs of succeeded jobs, whole, in order of
    completion. :func:`diff_preview` shows the start of them."""
    done = jobs.where((F.col("status") == "succeeded") & (F.coalesce("diff", F.lit("")) != ""))
    rows = done.select("repo_id", "job_id", "completed_at", "diff")
    return ordinal(rows, ["repo_id"], ["completed_at", "job_id"], "position")


def to_fix_jobs(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What approving these issues stores: new rows of fix jobs, and the issues' new status rows.

    Issues that are fixed already get neither. ``issues`` has the columns of the fix request. The id is a
    hash of the issue, so a repeated task writes the same rows.
    """
    asked = with_fix_prompt(gate_approve(issues).where("allowed"))
    jobs = asked.select(
        F.sha2(F.concat_ws("\u0001", F.lit("fix"), "issue_id", F.lit("1")), 256).alias("job_id"), "issue_id", "repo_id",
        "prompt", F.lit(None).cast("string").alias("output"), F.lit(None).cast("string").alias("diff"),
        F.lit("pending").alias("status"), F.lit(1).alias("attempt_number"),
        *[F.lit(None).cast("timestamp").alias(c) for c in ("started_at", "completed_at")],
    )
    return jobs, asked.select("issue_id", "repo_id", F.lit("approved").alias("status"))


def diff_preview(jobs: DataFrame, chars: int = K.DIFF_PREVIEW_CHARS) -> DataFrame:
    """The start of all diffs of succeeded jobs of a repository, in order of completion.

    A diff and the newline after it take at least two characters, so ``chars / 2`` diffs of at most
    ``chars`` characters are all that can show: the rest is left out before the texts are joined.
    """
    diffs = jobs.where((F.col("status") == "succeeded") & (F.coalesce("diff", F.lit("")) != "")).select(
        "repo_id", "job_id", "completed_at", F.left("diff", F.lit(chars)).alias("diff")
    )
    shown = first_rows(diffs, ["repo_id"], ["completed_at", "job_id"], (chars + 1) // 2, spread_by=["job_id"])
    ordered = F.sort_array(F.collect_list(F.struct("completed_at", "job_id", "diff")))
    text = F.array_join(F.transform(ordered, lambda x: x["diff"]), "\n")
    return shown.groupBy("repo_id").agg(F.left(text, F.lit(chars)).alias("diff_preview"))
