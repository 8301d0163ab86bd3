"""Whole jobs: from files to findings, issues and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.operators.findings import all_findings, dedup_findings, to_issues
from repolens.operators.health import penalty, score


def analyze(files: DataFrame, stacks: DataFrame | None = None, content: str = "content") -> DataFrame:
    """The deduplicated findings of a corpus."""
    return dedup_findings(all_findings(files, stacks=stacks, content=content))


def analyze_to_issues(files: DataFrame, run_id: str, stacks: DataFrame | None = None, content: str = "content") -> DataFrame:
    return to_issues(analyze(files, stacks, content), run_id)


def repo_health(files: DataFrame, stacks: DataFrame | None = None, content: str = "content") -> DataFrame:
    """One row per repository of the corpus: findings by severity, penalty and health score."""
    found = analyze(files, stacks, content)
    points = penalty(F.col("severity"))
    per_repo = found.groupBy("repo_id").agg(
        F.count("*").alias("findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in K.SEVERITIES],
        F.sum(points).cast("bigint").alias("penalty"),
    )
    repos = files.select("repo_id").distinct()
    rows = repos.join(per_repo, "repo_id", "left").fillna(0, ["findings", *K.SEVERITIES, "penalty"])
    return rows.withColumn("health_score", score(F.col("penalty")))
