"""Queries over the issue store: filters, lookups, gates, views, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.functions import jsontext as J
from repolens.functions import labels as L
from repolens.operators.skew import ordinal


def list_issues(
    issues: DataFrame, repo_id: str, severity: str | None = None, category: str | None = None, file_path: str | None = None
) -> DataFrame:
    """Issues of one repository; an empty filter is no filter."""
    rows = issues.where(F.col("repo_id") == repo_id)
    for name, wanted in (("severity", severity), ("category", category), ("file_path", file_path)):
        if wanted:
            rows = rows.where(F.col(name) == wanted)
    return rows


def list_issues_for(issues: DataFrame, requests: DataFrame) -> DataFrame:
    """:func:`list_issues` for many requests ``(request_id, repo_id, severity, category, file_path)``.

    Null or empty fields of a request filter nothing. A request is one key: its repository, and the file or that it
    asks for none. An issue has the two keys it can be asked by, so each is moved twice; severity and category, which
    have few values, are compared where a request and an issue of its key meet.
    """
    asks = {f: F.coalesce(f, F.lit("")) != "" for f in ("severity", "category", "file_path")}
    side = requests.select("request_id", F.col("repo_id").alias("_repo"), *[F.when(a, F.col(f)).alias(f"_{f}") for f, a in asks.items()])
    side = side.withColumn("_asked", F.col("_file_path").isNotNull())
    # The first key, a null, is that of requests for any file.
    keys = F.array(F.lit(None).cast("string"), "file_path")
    rows = issues.select("*", F.posexplode(keys).alias("_by", "_key"))
    same = [F.col("repo_id") == F.col("_repo"), (F.col("_by") == 1) == F.col("_asked"), F.col("_key").eqNullSafe(F.col("_file_path"))]
    fits = [F.col(f"_{f}").isNull() | (F.col(f) == F.col(f"_{f}")) for f in ("severity", "category")]
    return rows.join(side, [*same, *fits]).select("request_id", *issues.columns)


def get(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row with one id."""
    return df.where(F.col(key) == value)


def get_many(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids``, each once."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def status_partition(issues: DataFrame) -> DataFrame:
    """Adds ``part``: fixed, open or neither (approved issues are in neither)."""
    return issues.withColumn(
        "part", F.when(F.col("status").isin("fixed", "open"), F.col("status")).otherwise(F.lit("neither"))
    )


def split_status(df: DataFrame, first: str = "fixed", second: str = "open") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("status") == first), df.where(F.col("status") == second)


def severity_rank(severity: Column) -> Column:
    """0 for critical up to 3 for low, 4 for anything else."""
    levels = F.array(*[F.lit(s) for s in K.SEVERITIES])
    at = F.array_position(levels, severity)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(K.SEVERITIES))).cast("int")


def issues_sorted(issues: DataFrame, ranked: bool = False) -> DataFrame:
    """Adds ``position`` within the repository: by severity as text (or by rank), then by time."""
    first = severity_rank(F.col("severity")) if ranked else F.col("severity")
    return ordinal(issues, ["repo_id"], [first, "detected_at", "issue_id"], "position")


def progress_pct() -> Column:
    """The percentage of issue ``position`` of ``total``."""
    return (60 + F.floor((F.col("position") - 1) / F.col("total") * 30)).cast("int")


def issue_progress(issues: DataFrame, order: list | None = None) -> DataFrame:
    """Adds ``position`` (from 1), ``total`` and ``pct``: analysing issue i of n is at 60 + i/n of 30."""
    placed = ordinal(issues, ["repo_id"], order or ["detected_at", "issue_id"], "position")
    totals = issues.groupBy("repo_id").agg(F.count("*").alias("total"))
    rows = placed.join(totals, "repo_id")
    return rows.withColumn("pct", progress_pct())


def _gate(df: DataFrame, reason: Column) -> DataFrame:
    return df.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def gate_analysis(repos: DataFrame) -> DataFrame:
    """Analysis and test runs need a ready repository."""
    ok = F.col("status").isin("ready", "analyzing")
    return _gate(repos, F.when(~ok, F.concat(F.lit("not ready: "), F.col("status"))))


def gate_approve(issues: DataFrame) -> DataFrame:
    return _gate(issues, F.when(F.col("status") == "fixed", F.lit("already fixed")))


def gate_execute(jobs: DataFrame) -> DataFrame:
    return _gate(
        jobs,
        F.when(F.col("status") == "running", F.lit("already running")).when(
            F.col("status") == "succeeded", F.lit("already succeeded")
        ),
    )


def issue_view(issues: DataFrame) -> DataFrame:
    """Issues as shown: JSON texts made safe, time as text."""
    return issues.withColumns({
        "root_cause": J.safe_root_cause(F.col("root_cause")),
        "fix_plan": F.to_json(J.parse_json(F.col("fix_plan"))),
        "detected_at": L.iso_utc(F.col("detected_at")),
    })


def issue_brief(issues: DataFrame) -> DataFrame:
    """Issues as sent with progress events: no cause, plan or time."""
    return issues.select(
        "issue_id", "repo_id", "severity", "category", "title", "description", "file_path", "line_number",
        "evidence", "suggested_fix", "confidence", "status",
    )


def job_view(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "job_id", "issue_id", "repo_id", "status", "attempt_number", "output", "diff",
        L.iso_utc(F.col("started_at")).alias("started_at"), L.iso_utc(F.col("completed_at")).alias("completed_at"),
    )


def run_view(runs: DataFrame) -> DataFrame:
    return runs.select(
        "run_id", "repo_id", "job_id", "passed", "tests_total", "tests_passed", "tests_failed", "output",
        L.iso_utc(F.col("ran_at")).alias("ran_at"),
    )


def repo_view(repos: DataFrame) -> DataFrame:
    """Repositories with the fields of their scan metadata, which show only once a stack is known."""
    meta = F.when(F.coalesce("tech_stack", F.lit("")) != "", J.parse_json(F.col("scan_metadata")))
    field = lambda name, type_: F.try_variant_get(meta, f"$.{name}", type_).alias(name)
    return repos.select(
        "repo_id", "name", "status", "source_url", "tech_stack", "test_framework",
        field("file_count", "bigint"), field("total_size_bytes", "bigint"), field("language_counts", "map<string,bigint>"),
        "local_path",
    )


def metadata_with_job(repos: DataFrame, job_id: Column) -> DataFrame:
    """Scan metadata with ``analysis_job_id`` set; metadata that is no JSON object is replaced."""
    fields = F.try_variant_get(J.parse_json(F.col("scan_metadata")), "$", "map<string,variant>")
    kept = F.map_filter(fields, lambda name, _: name != "analysis_job_id")
    id_ = F.try_variant_get(F.to_variant_object(F.struct(job_id.alias("id"))), "$.id", "variant")
    own = F.create_map(F.lit("analysis_job_id"), id_)
    return repos.withColumn("scan_metadata", F.to_json(F.coalesce(F.map_concat(kept, own), own)))


def issue_labels(issues: DataFrame) -> DataFrame:
    return issues.select(
        "issue_id",
        L.confidence_pct(F.col("confidence")).cast("int").alias("confidence_pct"),
        L.location(F.col("file_path"), F.col("line_number")).alias("location"),
        L.category_label(F.col("category")).alias("category_label"),
    )
