"""Every registered query over tables without rows, and over filters that leave none: rows, not an exception."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from repolens.operators import issues as I
from repolens.operators import lifecycle as LC
from repolens.operators import profile as P
from repolens.operators import runs as R
from repolens.plans import report as RP
from repolens.plans.registry import QUERIES, Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
#: What counts a whole has a row of it.
ONE_ROW = {"run_metrics"}


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        pq.write_table(pq.read_table(path).slice(0, 0), f"{folder}/{os.path.basename(path)}")
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_of_empty_tables(spark, nothing, name):
    assert len(QUERIES[name](spark, nothing).collect()) == (1 if name in ONE_ROW else 0)


def test_operators_of_what_a_filter_leaves(spark):
    t = Tables(spark, FOLDER)
    none = F.lit(False)
    log, issues, jobs, runs = t.status_log.where(none), t.issues.where(none), t.jobs.where(none), t.runs.where(none)
    empty = [
        LC.status_transitions(log, "job_id"), LC.illegal_transitions(log, "job_id"), LC.latest_state(log, "job_id"), I.issues_sorted(issues), I.issues_sorted(issues, ranked=True),
        I.issue_progress(issues), R.runs_newest_first(runs), R.diff_preview(jobs), R.diffs_in_order(jobs), R.job_output(t.events.where(none)), RP.issue_refs(issues), P.tree_nodes(t.corpus.where(none).withColumn("size", F.lit(0).cast("long"))),
    ]
    assert [df.count() for df in empty] == [0] * len(empty)


def test_report_without_any_finished_fix(spark):
    """Repositories without issues, jobs or runs have a report, with no preview."""
    t = Tables(spark, FOLDER)
    pending = t.jobs.limit(1).withColumn("status", F.lit("pending"))
    for jobs in (pending, pending.limit(0)):
        report = RP.repo_report(t.repos.limit(3), t.issues.where("false"), jobs, t.runs.where("false"))
        assert [r.fixes.diff_preview for r in report.collect()] == [None] * 3
