"""What an analysis run leaves behind: its log of events, and the score its repository keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens import schemas
from repolens.operators import health as H
from repolens.operators.issues import progress_pct
from repolens.operators.skew import ordinal
from repolens.session import materialize

# Steps of a run with their percentages.
STARTING, PYTHON_SCAN, MISSING_TESTS, SCRIPT_SCAN, DEDUP, CAUSES, SCORING = 5, 15, 35, 45, 55, 60, 92
PYTHON_STACKS, SCRIPT_STACKS = ["python", "unknown"], ["javascript", "typescript", "unknown"]

_ISSUE = ["severity", "category", "title", "file_path", "line_number"]


def _event(seq: Column, event: str, step: str | None = None, pct=None, message=None, total=None, issue=None) -> Column:
    """One row of the log; messages may be texts or columns."""
    as_column = lambda v, type_: (v if isinstance(v, Column) else F.lit(v)).cast(type_)
    return F.struct(
        seq.cast("bigint").alias("seq"), F.lit(event).alias("event"), F.lit(step).cast("string").alias("step"), as_column(pct, "int").alias("pct"),
        as_column(message, "string").alias("message"), as_column(total, "bigint").alias("total_issues"),
        (issue if issue is not None else F.lit(None)).cast(schemas.EVENTS["issue"].dataType).alias("issue"),
    )


def _progress(seq: Column, step: str, pct, message) -> Column:
    return _event(seq, "progress", step, pct, message)


def run_events(runs: DataFrame, issues: DataFrame, order: list | None = None, step: str = "root_cause", helper: str = "Assistant") -> DataFrame:
    """``(repo_id, seq, event, step, pct, message, total_issues, issue)``: the log of one run per repository.

    ``runs`` has ``repo_id``, ``tech_stack`` and ``raw``, the findings before deduplication; ``issues`` are those after
    it. A run starts, scans what its stack asks for (a null stack is an unknown one), deduplicates, tells its
    progress and the issue for each of them in ``order``, scores and is done; ``seq`` counts from 1 without gaps.
    Null ``raw`` counts as 0. Issues of other repositories have no place in a log. ``step`` and ``helper`` name the
    part that finds root causes.

    Every event of an issue is a projection of its row with its position, so a repository of any size is split as
    positions are; per run only the events around them are made. The numbers of the runs, a narrow row each, are
    written first, so that a task which makes events of issues sorts its issues and those rows only.
    """
    stack = F.coalesce("tech_stack", F.lit("unknown"))
    totals = issues.groupBy("repo_id").agg(F.count("*").alias("_total"))
    python, script = stack.isin(PYTHON_STACKS).cast("int"), stack.isin(SCRIPT_STACKS).cast("int")
    head = (F.lit(3) + 2 * python + script).alias("_head")
    known = runs.select("repo_id", python.alias("_py"), script.alias("_js"), F.coalesce("raw", F.lit(0)).alias("_raw"), head)
    whole = materialize(known.join(totals, "repo_id", "left").fillna(0, ["_total"]), "runs")
    at, n, py = F.col("_head"), F.col("_total"), F.col("_py")
    end = at + 2 * n
    around = F.array(
        _progress(F.lit(1), "starting", STARTING, "Starting analysis..."),
        F.when(py == 1, _progress(F.lit(2), "python_scan", PYTHON_SCAN, "Scanning Python files...")),
        F.when(py == 1, _progress(F.lit(3), "missing_tests", MISSING_TESTS, "Checking test coverage...")),
        F.when(F.col("_js") == 1, _progress(2 + 2 * py, "js_scan", SCRIPT_SCAN, "Scanning JS/TS files...")),
        _progress(at - 1, "dedup", DEDUP, F.format_string("Found %d raw issues. Deduplicating...", F.col("_raw").cast("bigint"))),
        _progress(at, step, CAUSES, f"{helper} is analyzing root causes..."),
        _progress(end + 1, "scoring", SCORING, "Computing health score..."),
        _event(end + 2, "done", total=n),
    )
    fixed = whole.select("repo_id", F.inline(F.filter(around, lambda e: e.isNotNull())))
    placed = ordinal(issues, ["repo_id"], order or ["detected_at", "issue_id"], "position").select("repo_id", "issue_id", *_ISSUE, "position")
    placed = placed.join(whole.select("repo_id", "_head", F.col("_total").alias("total")), "repo_id").withColumn("pct", progress_pct())
    row = lambda i: at + 2 * F.col("position") - i
    told = F.format_string(f"{helper.replace('%', '%%')} analyzing issue %d/%d: %s", "position", "total", F.coalesce("title", F.lit("")))
    issue = F.struct(F.col("issue_id").alias("id"), *_ISSUE)
    each = F.array(_progress(row(1), step, F.col("pct"), told), _event(row(0), "issue_found", issue=issue))
    return fixed.unionByName(placed.select("repo_id", F.inline(each)))


def score_repositories(repos: DataFrame, issues: DataFrame) -> DataFrame:
    """``repos`` as rows of the repositories table, with the score of a run's ``issues`` as ``health_score_before``.

    ``repos`` are the repositories the run was over: without issues they score 100, whatever was there. Rows are
    appended to the table or to a :class:`repolens.sources.statelog.StateLog`, not changed in it.
    """
    scores = H.health_score(issues, repos).withColumnRenamed("health_score", "_score")
    kept = schemas.conform(repos, schemas.REPOSITORIES)
    return kept.join(scores, "repo_id").withColumn("health_score_before", F.col("_score")).drop("_score")
