"""Health scores and counts of issues, per repository.

Counts are grouped with partial sums in each task, so a repository with a large share of all issues
sends a few rows to its group, not its issues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.functions.jsontext import parse_json
from repolens.functions.labels import half_up
from repolens.functions.text import lookup_map


def penalty(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup_map(K.PENALTIES), severity), F.lit(0))


def score(points: Column) -> Column:
    """100 less the penalty points, at least 0; no issues is 100."""
    return F.greatest(F.lit(0), 100 - F.coalesce(points, F.lit(0))).cast("int")


def with_penalty(issues: DataFrame) -> DataFrame:
    return issues.withColumn("penalty", penalty(F.col("severity")))


def health_score(issues: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """``(repo_id, health_score)``; with ``repos``, those without issues come out with 100."""
    points = issues.groupBy("repo_id").agg(F.sum(penalty(F.col("severity"))).alias("points"))
    if repos is not None:
        points = repos.select("repo_id").join(points, "repo_id", "left")
    return points.select("repo_id", score(F.col("points")).alias("health_score"))


def severity_counts(issues: DataFrame) -> DataFrame:
    """``(repo_id, severity, issues)``; the four levels are always there, others if they occur."""
    counts = issues.groupBy("repo_id", "severity").agg(F.count("*").alias("n"))
    levels = F.transform(F.array(*map(F.lit, K.SEVERITIES)), lambda s: F.struct(s.alias("severity"), F.lit(0).cast("bigint").alias("n")))
    own = F.array(F.struct(F.col("severity").alias("severity"), F.col("n").alias("n")))
    rows = counts.select("repo_id", F.explode(F.concat(own, levels)).alias("r"))
    return rows.groupBy("repo_id", "r.severity").agg(F.sum("r.n").alias("issues"))


def category_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("repo_id", "category").agg(F.count("*").alias("issues"))


def issue_rollup(issues: DataFrame) -> DataFrame:
    """``(repo_id, category, severity, level, issues, open)``: counts per repository, category and severity, and
    their sums per repository and category, per repository, and of all, in one aggregation.

    ``level`` has a bit for each column summed over, 0 to 7, so that a null that was there can be told from one
    that stands for all. No issues: no rows.
    """
    return issues.rollup("repo_id", "category", "severity").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("issues"), F.count_if(F.col("status") == "open").alias("open")
    )


def severity_breakdown(issues: DataFrame) -> DataFrame:
    """``(repo_id, severity, total, fixed)`` for the four levels only."""
    per_repo = issues.groupBy("repo_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"total_{s}") for s in K.SEVERITIES],
        *[F.count_if((F.col("severity") == s) & (F.col("status") == "fixed")).alias(f"fixed_{s}") for s in K.SEVERITIES],
    )
    levels = F.array(*[
        F.struct(F.lit(s).alias("severity"), F.col(f"total_{s}").alias("total"), F.col(f"fixed_{s}").alias("fixed"))
        for s in K.SEVERITIES
    ])
    return per_repo.select("repo_id", F.inline(levels))


def fix_rate_pct(fixed: Column, total: Column) -> Column:
    """Percent, rounded half to even; 0 if there are no issues."""
    return F.when(total > 0, F.bround(fixed / total * 100)).otherwise(F.lit(0)).cast("int")


def issue_summary(issues: DataFrame) -> DataFrame:
    """One row per repository: totals by status, fix rate, score over the open issues."""
    status, points = F.col("status"), penalty(F.col("severity"))
    rows = issues.groupBy("repo_id").agg(
        F.count("*").alias("total"),
        F.count_if(status == "fixed").alias("fixed"),
        F.count_if(status == "open").alias("remaining"),
        F.count_if(status == "approved").alias("approved"),
        F.sum(F.when(status == "open", points)).alias("open_points"),
    )
    return rows.withColumn("fix_rate_pct", fix_rate_pct(F.col("fixed"), F.col("total")))


def fix_rate(issues: DataFrame) -> DataFrame:
    return issue_summary(issues).select("repo_id", "total", "fixed", "fix_rate_pct")


def improvement(before: Column, after: Column) -> Column:
    """Null if there is no score from before."""
    return after - before


def health_delta(repos: DataFrame, issues: DataFrame) -> DataFrame:
    """``(repo_id, before, after, improvement)``; after counts open issues only."""
    rows = repos.select("repo_id", F.col("health_score_before").alias("before")).join(
        issue_summary(issues).select("repo_id", "open_points"), "repo_id", "left"
    )
    after = score(F.col("open_points"))
    return rows.select("repo_id", "before", after.alias("after"), improvement(F.col("before"), after).alias("improvement"))


def job_counts(jobs: DataFrame) -> DataFrame:
    status = F.col("status")
    return jobs.groupBy("repo_id").agg(
        F.count("*").alias("total_jobs"),
        F.count_if(status == "succeeded").alias("succeeded"),
        F.count_if(status == "failed").alias("failed"),
    )


def _count_map(counts: DataFrame, key: str) -> DataFrame:
    """The counts of a repository as one map; keys are declared names, so it stays small."""
    pairs = F.sort_array(F.collect_list(F.struct(F.coalesce(key, F.lit("null")).alias(key), "issues")))
    return counts.groupBy("repo_id").agg(F.map_from_entries(pairs).alias(f"{key}_counts"))


def analysis_status(repos: DataFrame, issues: DataFrame) -> DataFrame:
    """Status, job and issue counts of every repository."""
    zeros = F.create_map(*[x for s in K.SEVERITIES for x in (F.lit(s), F.lit(0).cast("bigint"))])
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    totals = issues.groupBy("repo_id").agg(F.count("*").alias("total_issues"))
    return (
        repos.join(totals, "repo_id", "left")
        .join(_count_map(severity_counts(issues), "severity"), "repo_id", "left")
        .join(_count_map(category_counts(issues), "category"), "repo_id", "left")
        .select(
            "repo_id", "status",
            F.try_variant_get(parse_json(F.col("scan_metadata")), "$.analysis_job_id", "string").alias("job_id"),
            F.coalesce("total_issues", F.lit(0)).alias("total_issues"),
            F.col("health_score_before").alias("health_score"),
            F.coalesce("severity_counts", zeros).alias("severity_counts"),
            F.coalesce("category_counts", none).alias("category_counts"),
        )
    )


def dashboard(issues: DataFrame) -> DataFrame:
    """Cards of a repository; counts of zero and percentages of nothing are null."""
    per_repo = issues.groupBy("repo_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("critical_high"),
        F.count_if(F.col("status") == "fixed").alias("fixed"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in K.SEVERITIES],
        *[F.count_if((F.col("severity") == s) & (F.col("status") == "fixed")).alias(f"{s}_fixed") for s in K.SEVERITIES],
    )
    return per_repo.select(
        "repo_id", "total", "critical_high", "fixed",
        *[F.when(F.col(s) > 0, F.col(s)).alias(s) for s in K.SEVERITIES],
        *[
            F.when(F.col(s) > 0, half_up(F.col(f"{s}_fixed") / F.col(s) * 100)).cast("int").alias(f"{s}_fixed_pct")
            for s in K.SEVERITIES
        ],
    )
