"""Issues, jobs, runs and reports on small tables."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from repolens import constants as K
from repolens.operators import enrich as E
from repolens.operators import health as H
from repolens.operators import issues as I
from repolens.operators import runs as R
from repolens.plans import report as RP
from repolens.schemas import FIX_JOBS
from repolens.sources.tables import write_report

ISSUES = "issue_id string, repo_id string, severity string, category string, status string, title string, file_path string, line_number int, detected_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def issue(n, repo="r", severity="high", category="bug", status="open", minutes=0):
    return (f"i{n}", repo, severity, category, status, f"T{n}", f"f{n}.py", n, T0 + dt.timedelta(minutes=minutes or n))


@pytest.fixture
def issues(spark):
    rows = [issue(1, severity="critical"), issue(2, status="fixed"), issue(3, severity="medium", status="approved", category="security"),
            issue(4, severity="low", status="fixed"), issue(5, severity="info"), issue(6, "s", severity="low", status="fixed")]
    return spark.createDataFrame(rows, ISSUES)


@pytest.fixture
def repos(spark):
    return spark.createDataFrame([("r", "Repo", 60), ("s", "Side", None), ("t", "Tidy", 100)], "repo_id string, name string, health_score_before int")


@pytest.fixture
def jobs(spark):
    rows = [("j1", "i1", "r", "succeeded", "diff one", T0), ("j2", "i2", "r", "succeeded", "diff two", T0 - dt.timedelta(1)),
            ("j3", "i3", "r", "failed", "", T0), ("j4", "i9", "r", "succeeded", "", T0), ("j5", "i6", "s", "pending", None, None)]
    return spark.createDataFrame(rows, "job_id string, issue_id string, repo_id string, status string, diff string, completed_at timestamp")


@pytest.fixture
def runs(spark):
    rows = [("t1", "r", "j1", "3 passed", T0), ("t2", "r", None, "2 passed, 1 failed", T0 + dt.timedelta(1)), ("t3", "s", "j9", "", T0)]
    return R.parse_runs(spark.createDataFrame(rows, "run_id string, repo_id string, job_id string, output string, ran_at timestamp"))


def test_counts(issues):
    counts = {(r.repo_id, r.severity): r.issues for r in H.severity_counts(issues).collect()}
    assert counts == {("r", "critical"): 1, ("r", "high"): 1, ("r", "medium"): 1, ("r", "low"): 1, ("r", "info"): 1,
                      ("s", "critical"): 0, ("s", "high"): 0, ("s", "medium"): 0, ("s", "low"): 1}
    levels = {(r.repo_id, r.severity): (r.total, r.fixed) for r in H.severity_breakdown(issues).collect()}
    assert levels["r", "high"] == (1, 1) and levels["s", "high"] == (0, 0) and ("r", "info") not in levels
    card = H.dashboard(issues).where("repo_id = 'r'").first()
    assert (card.critical_high, card.fixed, card.high_fixed_pct, card.critical_fixed_pct) == (2, 2, 100, 0)


@pytest.mark.parametrize("fixed,total,pct", [(1, 8, 12), (3, 8, 38), (1, 40, 2), (3, 40, 8), (0, 0, 0), (2, 3, 67)])
def test_fix_rate_rounds_half_to_even(spark, fixed, total, pct):
    assert round(fixed / total * 100 if total else 0) == pct
    row = spark.createDataFrame([(fixed, total)], "f long, t long").select(H.fix_rate_pct(F.col("f"), F.col("t")).alias("p")).first()
    assert row.p == pct


def test_order_as_text_and_by_rank(issues):
    text = [r.severity for r in I.issues_sorted(issues.where("repo_id = 'r'")).orderBy("position").collect()]
    assert text == ["critical", "high", "info", "low", "medium"]
    ranked = [r.severity for r in I.issues_sorted(issues.where("repo_id = 'r'"), ranked=True).orderBy("position").collect()]
    assert ranked == ["critical", "high", "medium", "low", "info"]


def test_progress(issues):
    rows = I.issue_progress(issues).orderBy("repo_id", "position").collect()
    assert [(r.issue_id, r.pct) for r in rows] == [("i1", 60), ("i2", 66), ("i3", 72), ("i4", 78), ("i5", 84), ("i6", 60)]


def test_gates(spark, issues, jobs):
    repos = spark.createDataFrame([(s, s) for s in ("ready", "analyzing", "error")], "repo_id string, status string")
    assert {r.repo_id: r.reason for r in I.gate_analysis(repos).collect()} == {"ready": None, "analyzing": None, "error": "not ready: error"}
    assert {r.issue_id for r in I.gate_approve(issues).where("NOT allowed").collect()} == {"i2", "i4", "i6"}
    assert {r.job_id: r.reason for r in I.gate_execute(jobs).where("NOT allowed").collect()} == {j: "already succeeded" for j in ("j1", "j2", "j4")}


def test_report(repos, issues, jobs, runs):
    rows = {r.repo_id: r for r in RP.repo_report(repos, issues, jobs, runs).collect()}
    r, s, t = rows["r"], rows["s"], rows["t"]
    assert tuple(r.health) == (60, 80, 20) and tuple(s.health) == (None, 100, None) and tuple(t.health) == (100, 100, 0)
    assert (r.issues.total, r.issues.fixed, r.issues.remaining, r.issues.approved, r.issues.fix_rate_pct) == (5, 2, 2, 1, 40)
    assert r.issues.severity_breakdown["high"].fixed == 1 and r.issues.category_breakdown == {"bug": 4, "security": 1}
    assert tuple(r.fixes) == (4, 3, 1, "diff two\ndiff one") and s.fixes.diff_preview is None
    assert (r.tests.passed, r.tests.tests_total, r.tests.tests_failed, r.tests.ran_at) == (False, 3, 1, "2024-01-02T00:00:00")
    assert t.tests is None and t.issues.total == 0 and t.issues.severity_breakdown["low"].total == 0
    whole = RP.with_issue_lists(RP.repo_report(repos, issues, jobs, runs), RP.issue_refs(issues)).collect()
    r, t = (next(x for x in whole if x.repo_id == i) for i in "rt")
    assert [x.id for x in r.fixed_issue_list] == ["i2", "i4"] and [x.id for x in r.open_issue_list] == ["i1", "i5"]
    assert r.open_issue_list[0].title == "T1" and t.open_issue_list == []


def test_long_lists_are_rows(spark, repos, jobs, runs):
    """A repository with thousands of issues has one report and a row per issue."""
    many = spark.createDataFrame([issue(n, status="open" if n % 3 else "fixed") for n in range(1, 2501)], ISSUES)
    report = RP.repo_report(repos, many, jobs, runs).where("repo_id = 'r'").collect()
    assert len(report) == 1 and report[0].issues.total == 2500
    refs = RP.issue_refs(many).orderBy("list", "position").collect()
    by_time = sorted(many.collect(), key=lambda i: (i.detected_at, i.issue_id))
    for name in ("fixed", "open"):
        mine = [r for r in refs if r["list"] == name]
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert [r.issue_id for r in mine] == [i.issue_id for i in by_time if i.status == name]


def test_report_documents(repos, issues, jobs, runs, tmp_path):
    write_report(RP.repo_report(repos, issues, jobs, runs), str(tmp_path / "out"))
    documents = [json.loads(line) for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert {d["repo_id"] for d in documents} == {"r", "s", "t"}
    assert next(d for d in documents if d["repo_id"] == "r")["health"]["improvement"] == 20


def test_stored_reports_have_lists_as_rows(spark, repos, jobs, runs, tmp_path):
    """A repository with thousands of issues makes no long document."""
    many = spark.createDataFrame([issue(n, status="open" if n % 3 else "fixed") for n in range(1, 2501)], ISSUES)
    report, refs = RP.repo_report(repos, many, jobs, runs), RP.issue_refs(many)
    path = str(tmp_path / "out")
    RP.store_reports(report, refs, path)
    assert max(len(line) for f in (tmp_path / "out" / "reports").glob("*.json") for line in f.read_text().splitlines()) < 2000
    reports, rows = RP.read_reports(spark, path, report.schema, refs.schema)
    assert {r.repo_id for r in reports.collect()} == {"r", "s", "t"}
    columns = refs.columns
    assert sorted(map(tuple, rows.select(*columns).collect())) == sorted(map(tuple, refs.collect()))
    mine, own = RP.read_reports(spark, path, report.schema, refs.schema, "r")
    assert [r.repo_id for r in mine.collect()] == ["r"] and own.count() == 2500


def test_report_query_nests_no_lists(spark, monkeypatch):
    """It stores documents without lists and gives what it gave with them."""
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    monkeypatch.setattr(RP, "with_issue_lists", None)
    rows = __spark_entry__.queries()["report_documents"](spark, folder).collect()
    assert rows and any(" " in r.open_ids for r in rows)


def test_diff_preview_is_cut_like_the_whole_text(spark):
    rows = [(f"j{i:04}", "r", "succeeded", "x" * (i % 4) + str(i), T0 + dt.timedelta(seconds=i * 7 % 1000)) for i in range(4000)]
    rows += [("big", "s", "succeeded", "y" * 10_000, T0)]
    jobs = spark.createDataFrame(rows, "job_id string, repo_id string, status string, diff string, completed_at timestamp")
    got = {r.repo_id: r.diff_preview for r in R.diff_preview(jobs).collect()}
    whole = "\n".join(d for _, _, _, d, _ in sorted(rows[:-1], key=lambda r: (r[4], r[0])))
    assert got == {"r": whole[:3000], "s": "y" * 3000}
    short = R.diff_preview(jobs.where("repo_id = 'r'"), chars=11).first().diff_preview
    assert short == whole[:11]


def test_job_output_is_a_row_a_line(spark):
    rows = [("a", n, "output", f"line {n}") for n in range(25)] + [("a", 99, "done", "end"), ("b", 1, "output", "only")]
    events = spark.createDataFrame(rows, "job_id string, seq long, event string, message string").repartition(4)
    got = R.job_output(events).orderBy("job_id", "position").collect()
    assert [tuple(r) for r in got] == [("a", "line " + str(n), n + 1) for n in range(25)] + [("b", "only", 1)]


def test_whole_diffs_in_order(jobs):
    got = R.diffs_in_order(jobs).where("repo_id = 'r'").orderBy("position").collect()
    assert "\n".join(r["diff"] for r in got) == "diff two\ndiff one"


def test_approval_makes_jobs(spark):
    rows = [issue(n, status=s) for n, s in enumerate(("open", "fixed", "approved"), 1)]
    issues = spark.createDataFrame(rows, ISSUES).selectExpr("*", "'d' AS description", "'' AS evidence", "'' AS suggested_fix", "'' AS fix_plan")
    new, approved = R.to_fix_jobs(issues)
    got = sorted(new.collect(), key=lambda r: r.issue_id)
    assert [(r.issue_id, r.status, r.attempt_number, r.diff) for r in got] == [("i1", "pending", 1, None), ("i3", "pending", 1, None)]
    assert new.columns == [f.name for f in FIX_JOBS.fields]
    assert {tuple(r) for r in approved.collect()} == {("i1", "r", "approved"), ("i3", "r", "approved")}
    assert [r.job_id for r in R.to_fix_jobs(issues)[0].orderBy("issue_id").collect()] == [r.job_id for r in got]


def test_newest_run_without_times_and_with_ties(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("r", "t1", None, "1 passed"), ("r", "t2", None, "2 passed"), ("s", "a", at, "3 passed"), ("s", "b", at, "4 passed"), ("s", "c", None, "x"), (None, "n", at, "5 passed")]
    runs = spark.createDataFrame(rows, "repo_id string, run_id string, ran_at timestamp, output string")
    assert {(r.repo_id, r.run_id, r.output) for r in R.latest_run(runs).collect()} == {("r", "t2", "2 passed"), ("s", "b", "4 passed"), (None, "n", "5 passed")}
    ends = {r.repo_id: (r.first_run_id, r.latest_run_id, r.runs, r.latest_tests_passed) for r in R.first_vs_latest_run(runs).collect()}
    assert ends == {"r": ("t1", "t2", 2, 2), "s": ("c", "b", 3, 4), None: (None, "n", 1, 5)}
    plan = R.latest_run(runs)._jdf.queryExecution().executedPlan().toString()
    assert "max(struct(ran_at" not in plan


def test_runs(runs, jobs):
    latest = {r.repo_id: (r.run_id, r.passed) for r in R.latest_run(runs).collect()}
    assert latest == {"r": ("t2", False), "s": ("t3", False)}
    ends = {r.repo_id: (r.first_run_id, r.latest_run_id) for r in R.first_vs_latest_run(runs).collect()}
    assert ends == {"r": ("t1", "t2"), "s": (None, "t3")}
    joined = {r.run_id: (r.job_id, r.job_status) for r in R.runs_with_jobs(runs, jobs).collect()}
    assert joined == {"t1": ("j1", "succeeded"), "t2": (None, None), "t3": ("j9", None)}


def test_job_context_needs_both_sides(spark, jobs, issues, repos):
    got = {r.job_id: (r.title, r.repo_name) for r in R.job_context(jobs, issues, repos).collect()}
    assert got == {"j1": ("T1", "Repo"), "j2": ("T2", "Repo"), "j3": ("T3", "Repo"), "j5": ("T6", "Side")}


def test_status_after_jobs(issues, jobs):
    got = {r.issue_id: r.status for r in R.issue_status_after_jobs(issues, jobs).collect()}
    assert got == {"i1": "fixed", "i2": "fixed", "i3": "approved", "i4": "fixed", "i5": "open", "i6": "fixed"}
    outcomes = jobs.select("job_id", R.job_outcome(F.col("diff")).alias("o")).collect()
    assert {r.job_id for r in outcomes if r.o == "succeeded"} == {"j1", "j2"}


def test_causes_and_plans(spark):
    df = spark.createDataFrame([("security", "a.py"), ("other", None)], "category string, file_path string")
    known, other = E.with_root_cause(df).collect()
    assert known.root_cause.affected_lines == ["a.py"] and known.root_cause.root_cause == K.ROOT_CAUSES["security"][0]
    assert other.root_cause.fix_strategy == K.ROOT_CAUSES["code_quality"][1]
    known, other = E.with_fix_plan(df).collect()
    assert (known.fix_plan.steps, known.fix_plan.risk_level) == K.FIX_PLANS["security"]
    assert other.fix_plan.files_to_change == [""] and len(other.fix_plan.steps) == 3


def test_views(spark):
    repos = spark.createDataFrame([
        ("a", "n", "ready", None, "python", "pytest", "w", '{"file_count": 3, "language_counts": {"Go": 2}, "analysis_job_id": "old"}'),
        ("b", "n", "scanning", None, None, None, "w", '{"file_count": 3}'), ("c", "n", "error", None, "go", None, "w", "no json")],
        "repo_id string, name string, status string, source_url string, tech_stack string, test_framework string, local_path string, scan_metadata string")
    view = {r.repo_id: (r.file_count, r.language_counts) for r in I.repo_view(repos).collect()}
    assert view == {"a": (3, {"Go": 2}), "b": (None, None), "c": (None, None)}
    meta = {r.repo_id: json.loads(r.scan_metadata) for r in I.metadata_with_job(repos, F.lit('j"1')).collect()}
    assert meta == {"a": {"file_count": 3, "language_counts": {"Go": 2}, "analysis_job_id": 'j"1'}, "b": {"file_count": 3, "analysis_job_id": 'j"1'},
                    "c": {"analysis_job_id": 'j"1'}}


def test_issue_views(spark, issues):
    full = issues.withColumns({"root_cause": F.lit("plain"), "fix_plan": F.lit('{"steps": []}')})
    row = I.issue_view(full).where("issue_id = 'i1'").first()
    assert (row.root_cause, row.fix_plan, row.detected_at) == ('{"root_cause":"plain"}', '{"steps":[]}', "2024-01-01T00:01:00")
    status = H.analysis_status(spark.createDataFrame([("r", "ready", 5, '{"analysis_job_id":"x"}'), ("t", "error", None, None)],
                                                     "repo_id string, status string, health_score_before int, scan_metadata string"), issues)
    rows = {r.repo_id: r for r in status.collect()}
    assert rows["r"].severity_counts["info"] == 1 and rows["r"].job_id == "x" and rows["r"].category_counts == {"bug": 4, "security": 1}
    assert rows["t"].severity_counts == {s: 0 for s in K.SEVERITIES} and rows["t"].category_counts == {} and rows["t"].total_issues == 0
