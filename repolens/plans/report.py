"""Before/after reports of all repositories in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens import constants as K
from repolens.functions.labels import iso_utc
from repolens.operators import health as H
from repolens.operators import runs as R
from repolens.operators.skew import ordinal
from repolens.sources.tables import append_table, read_table, write_report

_REF = ["issue_id", "title", "severity", "category", "file_path", "line_number"]


def report_core(repos: DataFrame, issues: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """One flat row per repository.

    Issues, jobs and runs are grouped by repository first, each to one row, so the joins neither fan
    out nor meet a key twice. ``runs`` may be raw logs; then only the newest one is parsed.
    """
    run = R.latest_run(runs)
    if "tests_total" not in run.columns:
        run = R.parse_runs(run)
    run = run.select(
        "repo_id", F.col("passed").alias("tests_ok"), "tests_total", "tests_passed", "tests_failed",
        F.col("ran_at").alias("tests_ran_at"),
    )
    counts = ["total", "fixed", "remaining", "approved", "fix_rate_pct", "total_jobs", "succeeded", "failed"]
    rows = (
        repos.select("repo_id", "name", F.col("health_score_before").alias("before"))
        .join(H.issue_summary(issues), "repo_id", "left")
        .join(H.job_counts(jobs), "repo_id", "left")
        .join(run, "repo_id", "left")
        .fillna(0, counts)
    )
    after = H.score(F.col("open_points"))
    return rows.withColumn("after", after).withColumn("improvement", H.improvement(F.col("before"), F.col("after"))).drop(
        "open_points"
    )


def issue_refs(issues: DataFrame) -> DataFrame:
    """The fixed and open issues as short references, one row each, with their ``position`` in their list."""
    listed = issues.where(F.col("status").isin("fixed", "open"))
    placed = ordinal(listed, ["repo_id", "status"], ["detected_at", "issue_id"], "position")
    return placed.select("repo_id", F.col("status").alias("list"), "position", *_REF)


def store_reports(reports: DataFrame, refs: DataFrame, path: str) -> None:
    """Reports as one document per repository, and beside them their issue lists as one row per issue, in
    buckets of repositories. Files of a large repository are as many as its issues ask for."""
    write_report(reports, f"{path}/reports")
    append_table(refs, f"{path}/issue_refs", refs.schema)


def read_reports(spark: SparkSession, path: str, report: T.StructType, refs: T.StructType, repo_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What :func:`store_reports` wrote, of the given schemas; with ``repo_id`` of that repository."""
    reports = spark.read.schema(report).json(f"{path}/reports")
    rows = read_table(spark, f"{path}/issue_refs", refs, repo_id)
    return (reports if repo_id is None else reports.where(F.col("repo_id") == repo_id)), rows


def with_issue_lists(reports: DataFrame, refs: DataFrame) -> DataFrame:
    """Whole documents: reports with their issue lists nested. For the repositories asked for, as a
    document holds all its issues in one row."""
    ref = F.struct("position", F.struct(F.col("issue_id").alias("id"), *_REF[1:]).alias("ref"))
    nested = lambda name: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("list") == name, ref))), lambda x: x.ref
    ).alias(f"{name}_issue_list")
    lists = refs.join(reports.select("repo_id"), "repo_id", "left_semi").groupBy("repo_id").agg(nested("fixed"), nested("open"))
    none = F.array().cast("array<struct<id:string,title:string,severity:string,category:string,file_path:string,line_number:int>>")
    empty = {c: F.coalesce(c, none) for c in ("fixed_issue_list", "open_issue_list")}
    return reports.join(lists, "repo_id", "left").withColumns(empty)


def repo_report(repos: DataFrame, issues: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Nested reports, one row per repository.

    Their issue lists are rows of their own, :func:`issue_refs`, so that no row grows with a repository;
    :func:`with_issue_lists` puts them in.
    """
    levels = H.severity_breakdown(issues)
    by_level = levels.groupBy("repo_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", F.struct("total", "fixed").alias("n"))))).alias(
            "severity_breakdown"
        )
    )
    by_category = H.category_counts(issues).groupBy("repo_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("category", F.lit("null")).alias("category"), "issues")))).alias("category_breakdown")
    )
    zeros = F.create_map(*[
        x for s in K.SEVERITIES
        for x in (F.lit(s), F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("fixed")))
    ])
    no_categories = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    rows = (
        report_core(repos, issues, jobs, runs)
        .join(by_level, "repo_id", "left")
        .join(by_category, "repo_id", "left")
        .join(R.diff_preview(jobs), "repo_id", "left")
    )
    tests = F.when(
        F.col("tests_total").isNotNull(),
        F.struct(
            F.col("tests_ok").alias("passed"), "tests_total", "tests_passed", "tests_failed",
            iso_utc(F.col("tests_ran_at")).alias("ran_at"),
        ),
    )
    return rows.select(
        "repo_id",
        F.col("name").alias("repo_name"),
        iso_utc(F.current_timestamp()).alias("generated_at"),
        F.struct("before", "after", "improvement").alias("health"),
        F.struct(
            "total", "fixed", "remaining", "approved", "fix_rate_pct",
            F.coalesce("severity_breakdown", zeros).alias("severity_breakdown"),
            F.coalesce("category_breakdown", no_categories).alias("category_breakdown"),
        ).alias("issues"),
        F.struct("total_jobs", "succeeded", "failed", "diff_preview").alias("fixes"),
        tests.alias("tests"),
    )
