"""Queries over issues, fix jobs, test runs, events and reports."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens import constants as K
from repolens import schemas
from repolens.functions import jsontext as J
from repolens.functions import labels as L
from repolens.functions import logs
from repolens.functions import prompts as PR
from repolens.operators import enrich as E
from repolens.operators import findings as FD
from repolens.operators import health as H
from repolens.operators import issues as I
from repolens.operators import lifecycle as LC
from repolens.operators import runs as R
from repolens.operators import sessions as SS
from repolens.plans import report as RP
from repolens.plans import runlog
from repolens.plans.registry import Tables, choose, literal, query
from repolens.session import ensure_checkpoint_dir
from repolens.sources.events import parse_events
from repolens.sources.statelog import StateLog
from repolens.sources.tables import append_table, read_table
from repolens.streaming import folds

_PENALTY = "CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END"
_N = "CAST(count(*) AS bigint)"


def _count_if(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS bigint)"


@query("""
SELECT q.request_id, i.issue_id, i.repo_id, i.severity, i.category, i.file_path FROM {ISSUES} i JOIN {REQUESTS} q ON q.repo_id = i.repo_id
WHERE coalesce(q.severity, '') IN ('', i.severity) AND coalesce(q.category, '') IN ('', i.category) AND coalesce(q.file_path, '') IN ('', i.file_path)
""")
def issues_filter(t: Tables) -> DataFrame:
    found = I.list_issues_for(t.issues, t.requests)
    return found.select("request_id", "issue_id", "repo_id", "severity", "category", "file_path")


@query("SELECT issue_id, repo_id, severity, title FROM {ISSUES} i WHERE issue_id IN (SELECT issue_id FROM {JOBS} j)")
def issue_by_id(t: Tables) -> DataFrame:
    return I.get_many(t.issues, "issue_id", t.jobs).select("issue_id", "repo_id", "severity", "title")


@query("SELECT issue_id, CASE WHEN status IN ('fixed', 'open') THEN status ELSE 'neither' END AS part FROM {ISSUES} i")
def status_partition(t: Tables) -> DataFrame:
    return I.status_partition(t.issues).select("issue_id", "part")


@query("""
SELECT 'analysis' AS gate, repo_id AS id, CASE WHEN status NOT IN ('ready', 'analyzing') THEN concat('not ready: ', status) ELSE '' END AS reason FROM {REPOS} r UNION ALL
SELECT 'approve', issue_id, CASE WHEN status = 'fixed' THEN 'already fixed' ELSE '' END FROM {ISSUES} i UNION ALL
SELECT 'execute', job_id, CASE WHEN status = 'running' THEN 'already running' WHEN status = 'succeeded' THEN 'already succeeded' ELSE '' END FROM {JOBS} j
""")
def gate_requests(t: Tables) -> DataFrame:
    def rows(gate, df, key):
        return df.select(F.lit(gate).alias("gate"), F.col(key).alias("id"), F.coalesce("reason", F.lit("")).alias("reason"))

    return (
        rows("analysis", I.gate_analysis(t.repos), "repo_id")
        .unionByName(rows("approve", I.gate_approve(t.issues), "issue_id"))
        .unionByName(rows("execute", I.gate_execute(t.jobs), "job_id"))
    )


@query("""
SELECT repo_id, name, coalesce(tech_stack, '-') AS tech_stack, CAST(CASE WHEN shown THEN k ELSE -1 END AS bigint) AS file_count,
  CAST(CASE WHEN shown THEN k * 1000 ELSE -1 END AS bigint) AS total_size_bytes, CAST(CASE WHEN shown THEN k % 9 ELSE -1 END AS bigint) AS python_files
FROM (SELECT *, coalesce(tech_stack, '') <> '' AND coalesce(json_valid(scan_metadata), FALSE) AS shown, CAST(substr(repo_id, 2) AS bigint) AS k FROM {SCANNED} s) x
""")
def repo_view(t: Tables) -> DataFrame:
    return I.repo_view(t.scanned).select(
        "repo_id", "name", F.coalesce("tech_stack", F.lit("-")).alias("tech_stack"),
        F.coalesce("file_count", F.lit(-1)).alias("file_count"),
        F.coalesce("total_size_bytes", F.lit(-1)).alias("total_size_bytes"),
        F.coalesce(F.try_element_at("language_counts", F.lit("Python")), F.lit(-1)).alias("python_files"),
    )


_DEFAULT_CAUSE, _DEFAULT_FIX = K.ROOT_CAUSES[K.DEFAULT_CATEGORY]


@query(f"""
SELECT issue_id, {choose('category', {c: v[0] for c, v in K.ROOT_CAUSES.items()}, _DEFAULT_CAUSE)} AS root_cause,
  {choose('category', {c: v[1] for c, v in K.ROOT_CAUSES.items()}, _DEFAULT_FIX)} AS fix_strategy, file_path AS affected_lines FROM {{ISSUES}} i
""")
def root_cause_lookup(t: Tables) -> DataFrame:
    return E.with_root_cause(t.issues).select(
        "issue_id", "root_cause.root_cause", "root_cause.fix_strategy",
        F.array_join("root_cause.affected_lines", "|").alias("affected_lines"),
    )


@query(f"""
SELECT issue_id, {choose('category', {c: '|'.join(v[0]) for c, v in K.FIX_PLANS.items()}, '-')} AS steps,
  {choose('category', {c: v[1] for c, v in K.FIX_PLANS.items()}, '-')} AS risk_level, file_path AS files_to_change FROM {{ISSUES}} i
""")
def fix_plan_lookup(t: Tables) -> DataFrame:
    return E.with_fix_plan(t.issues).select(
        "issue_id", F.array_join("fix_plan.steps", "|").alias("steps"), "fix_plan.risk_level",
        F.array_join("fix_plan.files_to_change", "|").alias("files_to_change"),
    )


@query(f"""
SELECT issue_id, {choose('category', {c: '|'.join(v[0]) for c, v in K.FIX_PLANS.items()}, '-')} AS steps,
  {choose('category', {c: v[1] for c, v in K.FIX_PLANS.items()}, '-')} AS risk_level FROM {{ISSUES}} i
""")
def stored_fix_plan(t: Tables) -> DataFrame:
    """Plans stored on issues as text, and read back as fix requests read them."""
    plan = F.col("fix_plan")
    return E.with_stored_plan(t.issues).select(
        "issue_id", F.array_join(J.plan_steps(plan), "|").alias("steps"), F.get_json_object(plan, "$.risk_level").alias("risk_level")
    )


@query("""
SELECT issue_id, concat('{"root_cause":"why ', title, '"}') AS root_cause, CASE WHEN line_number % 2 = 1 THEN '{"steps":["a"]}' ELSE '-' END AS fix_plan,
  strftime(detected_at, '%Y-%m-%dT%H:%M:%S') AS detected_at, status FROM {ISSUES} i
""")
def issue_view(t: Tables) -> DataFrame:
    kept = t.issues.withColumns({
        "root_cause": F.concat(F.lit("why "), "title"),
        "fix_plan": F.when(F.col("line_number") % 2 == 1, '{"steps": ["a"]}').otherwise("no plan"),
    })
    return I.issue_view(kept).select("issue_id", "root_cause", "fix_plan", "detected_at", "status").fillna("-", ["fix_plan"])


_PROMPT = """(SELECT issue_id, file_path, line_number, title, concat('Fix the following issue in the repository:', chr(10), chr(10), 'File: ', file_path, chr(10),
  'Line: ', CASE WHEN line_number = 0 THEN 'unknown' ELSE CAST(line_number AS varchar) END, chr(10), 'Issue: ', title, chr(10), 'Description: ', description, chr(10),
  'Evidence: ', CASE WHEN evidence = '' THEN 'none' ELSE evidence END, chr(10), 'Suggested fix: ', coalesce(suggested_fix, 'none'), chr(10),
  CASE WHEN line_number % 3 = 0 THEN concat(chr(10), 'Fix plan:', chr(10), '  1. one', chr(10), '  2. two', chr(10)) ELSE '' END, chr(10),
  'Apply the minimal correct fix. Do not modify any other files. Do not add extra comments or whitespace changes.') AS prompt FROM {FULL_ISSUES} f)"""


@query(f"SELECT issue_id, prompt FROM {_PROMPT} p")
def build_fix_prompt(t: Tables) -> DataFrame:
    return E.with_fix_prompt(t.full_issues).select("issue_id", "prompt")


@query(f"""
SELECT issue_id, trim(regexp_extract(prompt, '(?m)^File:\\s*(.+)$', 1)) AS file, lower(trim(regexp_extract(prompt, '(?m)^Issue:\\s*(.+)$', 1))) AS issue,
  coalesce(try_cast(regexp_extract(prompt, '(?m)^Line:\\s*(\\d+)', 1) AS int), -1) AS line FROM {_PROMPT} p
""")
def parse_fix_prompt(t: Tables) -> DataFrame:
    prompts = E.with_fix_prompt(t.full_issues)
    return prompts.select("issue_id", PR.parse_fix_prompt(F.col("prompt")).alias("p")).select(
        "issue_id", "p.file", "p.issue", F.coalesce("p.line", F.lit(-1)).alias("line")
    )


_LOG = """(SELECT run_id, repo_id, job_id, ran_at, coalesce(try_cast(regexp_extract(output, '(\\d+) passed', 1) AS int), 0) AS p,
  coalesce(try_cast(regexp_extract(output, '(\\d+) failed', 1) AS int), 0) + coalesce(try_cast(regexp_extract(output, '(\\d+) error', 1) AS int), 0) AS f FROM {RUNS} r)"""


@query(f"SELECT run_id, p + f AS total, p AS passed, f AS failed FROM {_LOG} l")
def parse_test_log(t: Tables) -> DataFrame:
    return t.runs.select("run_id", logs.parse_test_log(F.col("output")).alias("l")).select("run_id", "l.*")


@query("SELECT job_id, CASE WHEN length(trim(coalesce(diff, ''))) > 0 THEN 'succeeded' ELSE 'failed' END AS outcome FROM {JOBS} j")
def job_outcome(t: Tables) -> DataFrame:
    return t.jobs.select("job_id", R.job_outcome(F.col("diff")).alias("outcome"))


@query("""
SELECT j.job_id, j.issue_id, j.repo_id, i.title, r.name AS repo_name FROM {JOBS} j JOIN {ISSUES} i ON i.issue_id = j.issue_id JOIN {REPOS} r ON r.repo_id = j.repo_id
""")
def job_context(t: Tables) -> DataFrame:
    return R.job_context(t.jobs, t.issues, t.repos).select("job_id", "issue_id", "repo_id", "title", "repo_name")


@query("""
SELECT r.run_id, coalesce(r.job_id, '-') AS job_id, coalesce(j.issue_id, '-') AS issue_id, coalesce(j.status, '-') AS job_status
FROM {RUNS} r LEFT JOIN {JOBS} j ON j.job_id = r.job_id
""")
def runs_with_jobs(t: Tables) -> DataFrame:
    return R.runs_with_jobs(t.runs, t.jobs).select(
        "run_id", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("job_id", "issue_id", "job_status")]
    )


@query(f"""
SELECT r.repo_id, CAST(greatest(0, 100 - coalesce(sum({_PENALTY}), 0)) AS int) AS health_score FROM {{REPOS}} r LEFT JOIN {{ISSUES}} i ON i.repo_id = r.repo_id GROUP BY r.repo_id
""")
def health_score(t: Tables) -> DataFrame:
    return H.health_score(t.issues, t.repos)


@query(f"""
SELECT repo_id, severity, CAST(sum(n) AS bigint) AS issues FROM (SELECT repo_id, severity, 1 AS n FROM {{ISSUES}} i UNION ALL
  SELECT DISTINCT repo_id, unnest([{', '.join(map(literal, K.SEVERITIES))}]), 0 FROM {{ISSUES}} i) x GROUP BY repo_id, severity
""")
def severity_counts(t: Tables) -> DataFrame:
    return H.severity_counts(t.issues)


@query(f"SELECT repo_id, category, {_N} AS issues FROM {{ISSUES}} i GROUP BY repo_id, category")
def category_counts(t: Tables) -> DataFrame:
    return H.category_counts(t.issues)


@query(f"""
SELECT coalesce(repo_id, '*') AS repo_id, coalesce(category, '*') AS category, coalesce(severity, '*') AS severity,
  CAST(grouping(repo_id, category, severity) AS int) AS level, {_N} AS issues, {_count_if("status = 'open'")} AS open
FROM {{ISSUES}} i GROUP BY ROLLUP (repo_id, category, severity)
""")
def issue_rollup(t: Tables) -> DataFrame:
    return H.issue_rollup(t.issues).fillna("*", ["repo_id", "category", "severity"])


@query(f"""
SELECT r.repo_id, l.severity, CAST(count(i.issue_id) AS bigint) AS total, {_count_if("i.status = 'fixed'")} AS fixed
FROM (SELECT DISTINCT repo_id FROM {{ISSUES}} a) r CROSS JOIN (SELECT unnest([{', '.join(map(literal, K.SEVERITIES))}]) AS severity) l
LEFT JOIN {{ISSUES}} i ON i.repo_id = r.repo_id AND i.severity = l.severity GROUP BY r.repo_id, l.severity
""")
def severity_breakdown(t: Tables) -> DataFrame:
    return H.severity_breakdown(t.issues)


@query(f"""
SELECT repo_id, {_N} AS total, {_count_if("status = 'fixed'")} AS fixed,
  CAST(round_even(count(*) FILTER (WHERE status = 'fixed') / count(*) * 100, 0) AS int) AS fix_rate_pct FROM {{ISSUES}} i GROUP BY repo_id
""")
def fix_rate(t: Tables) -> DataFrame:
    return H.fix_rate(t.issues)


_DELTA = f"""(SELECT r.repo_id, r.health_score_before AS before, CAST(greatest(0, 100 - coalesce(p, 0)) AS int) AS after FROM {{REPOS}} r
  LEFT JOIN (SELECT repo_id, sum({_PENALTY}) AS p FROM {{ISSUES}} i WHERE status = 'open' GROUP BY repo_id) o ON o.repo_id = r.repo_id)"""


@query(f"SELECT repo_id, before, after, after - before AS improvement FROM {_DELTA} d")
def health_delta(t: Tables) -> DataFrame:
    return H.health_delta(t.repos, t.issues)


@query(f"""
SELECT repo_id, CASE WHEN before IS NULL THEN 'none' WHEN before >= 80 THEN 'green' WHEN before >= 60 THEN 'yellow' ELSE 'red' END AS band_before,
  CASE WHEN after >= 80 THEN 'green' WHEN after >= 60 THEN 'yellow' ELSE 'red' END AS band_after FROM {_DELTA} d
""")
def score_band(t: Tables) -> DataFrame:
    rows = H.health_delta(t.repos, t.issues)
    return rows.select(
        "repo_id", L.score_band(F.col("before")).alias("band_before"), L.score_band(F.col("after")).alias("band_after")
    )


@query(f"""
SELECT repo_id, CASE WHEN before IS NULL THEN '-' WHEN after > before THEN concat('+', after - before, ' pts') WHEN after = before THEN 'No change'
  ELSE concat(after - before, ' pts') END AS label FROM {_DELTA} d
""")
def improvement_label(t: Tables) -> DataFrame:
    rows = H.health_delta(t.repos, t.issues)
    return rows.select("repo_id", F.coalesce(L.improvement_label(F.col("improvement")), F.lit("-")).alias("label"))


@query(f"""
SELECT issue_id, CAST(floor(CAST(CAST(substr(issue_id, 2) AS bigint) % 1001 AS double) / 1000 * 100 + 0.5) AS int) AS confidence_pct,
  CASE WHEN line_number = 0 THEN file_path ELSE concat(file_path, ':', line_number) END AS location,
  {choose('category', K.CATEGORY_LABELS, '-')} AS category_label FROM {{ISSUES}} i
""")
def issue_labels(t: Tables) -> DataFrame:
    confidence = (F.substring("issue_id", 2, 20).cast("bigint") % 1001).cast("double") / 1000
    return I.issue_labels(t.issues.withColumn("confidence", confidence))


@query(f"""
SELECT repo_id, {_N} AS total_jobs, {_count_if("status = 'succeeded'")} AS succeeded, {_count_if("status = 'failed'")} AS failed FROM {{JOBS}} j GROUP BY repo_id
""")
def job_counts(t: Tables) -> DataFrame:
    return H.job_counts(t.jobs)


_PREVIEW = """(SELECT repo_id, left(string_agg(diff, chr(10) ORDER BY completed_at, job_id), 3000) AS diff_preview FROM {JOBS} j
  WHERE status = 'succeeded' AND coalesce(diff, '') <> '' GROUP BY repo_id)"""


@query(f"SELECT repo_id, diff_preview FROM {_PREVIEW} p")
def diff_preview(t: Tables) -> DataFrame:
    return R.diff_preview(t.jobs)


@query("SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS position, message AS line FROM {EVENTS} e WHERE event = 'output'")
def job_output(t: Tables) -> DataFrame:
    return R.job_output(t.events)


@query("""
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY completed_at, job_id) AS position, job_id, diff FROM {JOBS} j
WHERE status = 'succeeded' AND coalesce(diff, '') <> ''
""")
def diffs_in_order(t: Tables) -> DataFrame:
    return R.diffs_in_order(t.jobs).drop("completed_at")


@query("""
SELECT repo_id, status AS list, row_number() OVER (PARTITION BY repo_id, status ORDER BY detected_at, issue_id) AS position, issue_id, title, severity, category, file_path, line_number
FROM {ISSUES} i WHERE status IN ('fixed', 'open')
""")
def issue_refs(t: Tables) -> DataFrame:
    return RP.issue_refs(t.issues)


@query(f"""
SELECT r.repo_id, r.status, CASE WHEN json_valid(r.scan_metadata) THEN concat('a', substr(r.repo_id, 2)) ELSE '-' END AS job_id, CAST(count(i.issue_id) AS bigint) AS total_issues,
  r.health_score_before AS health_score, {', '.join(f"{_count_if(f'i.severity = {literal(s)}')} AS {s}" for s in K.SEVERITIES)}, {_count_if("i.severity = 'info'")} AS info,
  {', '.join(f"{_count_if(f'i.category = {literal(c)}')} AS {c}" for c in K.CATEGORY_LABELS)}
FROM {{SCANNED}} r LEFT JOIN {{ISSUES}} i ON i.repo_id = r.repo_id GROUP BY ALL
""")
def analysis_status(t: Tables) -> DataFrame:
    count = lambda m, k: F.coalesce(F.try_element_at(f"{m}_counts", F.lit(k)), F.lit(0)).cast("bigint").alias(k)
    return H.analysis_status(t.scanned, t.issues).select(
        "repo_id", "status", F.coalesce("job_id", F.lit("-")).alias("job_id"), "total_issues", "health_score",
        *[count("severity", s) for s in [*K.SEVERITIES, "info"]], *[count("category", c) for c in K.CATEGORY_LABELS],
    )


def _card(s: str) -> str:
    of = f"count(*) FILTER (WHERE severity = '{s}')"
    fixed = f"count(*) FILTER (WHERE severity = '{s}' AND status = 'fixed')"
    return (
        f"CAST(CASE WHEN {of} > 0 THEN {of} ELSE -1 END AS bigint) AS {s}, "
        f"CAST(CASE WHEN {of} > 0 THEN floor({fixed} / {of} * 100 + 0.5) ELSE -1 END AS int) AS {s}_fixed_pct"
    )


@query(f"""
SELECT repo_id, {_N} AS total, {_count_if("severity IN ('critical', 'high')")} AS critical_high, {_count_if("status = 'fixed'")} AS fixed,
  {', '.join(map(_card, K.SEVERITIES))} FROM {{ISSUES}} i GROUP BY repo_id
""")
def dashboard(t: Tables) -> DataFrame:
    return H.dashboard(t.issues).fillna(-1)


@query("""
SELECT issue_id, repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY detected_at, issue_id) AS position, CAST(count(*) OVER (PARTITION BY repo_id) AS bigint) AS total,
  CAST(60 + floor((row_number() OVER (PARTITION BY repo_id ORDER BY detected_at, issue_id) - 1) / count(*) OVER (PARTITION BY repo_id) * 30) AS int) AS pct FROM {ISSUES} i
""")
def issue_progress(t: Tables) -> DataFrame:
    return I.issue_progress(t.issues).select("issue_id", "repo_id", "position", "total", "pct")


@query("SELECT issue_id, repo_id, severity, row_number() OVER (PARTITION BY repo_id ORDER BY severity, detected_at, issue_id) AS position FROM {ISSUES} i")
def issues_sorted(t: Tables) -> DataFrame:
    return I.issues_sorted(t.issues).select("issue_id", "repo_id", "severity", "position")


@query("""
SELECT issue_id, repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END,
  detected_at, issue_id) AS position FROM {ISSUES} i
""")
def issues_ranked(t: Tables) -> DataFrame:
    return I.issues_sorted(t.issues, ranked=True).select("issue_id", "repo_id", "position")


@query("SELECT DISTINCT repo_id, file_path FROM {ISSUES} i WHERE coalesce(file_path, '') <> ''")
def files_with_issues(t: Tables) -> DataFrame:
    return FD.files_with_issues(t.issues)


@query("SELECT run_id, repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY ran_at DESC, run_id DESC) AS position FROM {RUNS} r")
def runs_newest_first(t: Tables) -> DataFrame:
    return R.runs_newest_first(t.runs).select("run_id", "repo_id", "position")


_LATEST = f"(SELECT * FROM {_LOG} l QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ran_at DESC, run_id DESC) = 1)"


@query(f"""
SELECT repo_id, run_id, p + f > 0 AND f = 0 AS passed, p + f AS tests_total, p AS tests_passed, f AS tests_failed, strftime(ran_at, '%Y-%m-%dT%H:%M:%S') AS ran_at FROM {_LATEST} l
""")
def latest_test_run(t: Tables) -> DataFrame:
    return R.parse_runs(R.latest_run(t.runs.drop("job_id"))).drop("output").withColumn("ran_at", L.iso_utc(F.col("ran_at")))


@query(f"""
SELECT repo_id, runs, CASE WHEN runs > 1 THEN fr.run_id ELSE '-' END AS first_run_id, CASE WHEN runs > 1 THEN fr.p ELSE -1 END AS first_tests_passed,
  CASE WHEN runs > 1 THEN fr.f ELSE -1 END AS first_tests_failed, lr.run_id AS latest_run_id, lr.p AS latest_tests_passed, lr.f AS latest_tests_failed FROM
  (SELECT repo_id, {_N} AS runs, min(row(ran_at, run_id, p, f)) AS a, max(row(ran_at, run_id, p, f)) AS b FROM {_LOG} l GROUP BY repo_id) g,
  LATERAL (SELECT a[2] AS run_id, a[3] AS p, a[4] AS f) fr, LATERAL (SELECT b[2] AS run_id, b[3] AS p, b[4] AS f) lr
""")
def first_vs_latest_run(t: Tables) -> DataFrame:
    rows = R.first_vs_latest_run(t.runs)
    return rows.fillna("-", ["first_run_id"]).fillna(-1, ["first_tests_passed", "first_tests_failed"])


_SUMMARY = f"""(SELECT repo_id, {_N} AS total, {_count_if("status = 'fixed'")} AS fixed, {_count_if("status = 'open'")} AS remaining, {_count_if("status = 'approved'")} AS approved,
  CAST(round_even(count(*) FILTER (WHERE status = 'fixed') / count(*) * 100, 0) AS int) AS fix_rate_pct FROM {{ISSUES}} i GROUP BY repo_id)"""
_JOBS = f"""(SELECT repo_id, {_N} AS total_jobs, {_count_if("status = 'succeeded'")} AS succeeded, {_count_if("status = 'failed'")} AS failed FROM {{JOBS}} j GROUP BY repo_id)"""
_CORE = f"""(SELECT r.repo_id, r.name, d.before, d.after, d.after - d.before AS improvement, coalesce(total, 0) AS total, coalesce(fixed, 0) AS fixed, coalesce(remaining, 0) AS remaining,
  coalesce(approved, 0) AS approved, coalesce(fix_rate_pct, 0) AS fix_rate_pct, coalesce(total_jobs, 0) AS total_jobs, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed,
  coalesce(l.p + l.f, -1) AS tests_total, coalesce(l.p, -1) AS tests_passed, coalesce(l.f, -1) AS tests_failed, coalesce(strftime(l.ran_at, '%Y-%m-%dT%H:%M:%S'), '-') AS tests_ran_at
FROM {{REPOS}} r JOIN {_DELTA} d ON d.repo_id = r.repo_id LEFT JOIN {_SUMMARY} s ON s.repo_id = r.repo_id LEFT JOIN {_JOBS} j ON j.repo_id = r.repo_id LEFT JOIN {_LATEST} l ON l.repo_id = r.repo_id)"""


@query(f"SELECT * FROM {_CORE} c")
def report_core(t: Tables) -> DataFrame:
    rows = RP.report_core(t.repos, t.issues, t.jobs, t.runs).drop("tests_ok")
    rows = rows.withColumn("tests_ran_at", L.iso_utc(F.col("tests_ran_at")))
    return rows.fillna(-1, ["tests_total", "tests_passed", "tests_failed"]).fillna("-", ["tests_ran_at"])


_REPORT = f"""(SELECT c.repo_id, c.name, c.before, c.after, c.total, c.fixed, c.remaining, c.approved, c.fix_rate_pct, c.total_jobs, c.succeeded, c.failed, c.tests_total,
  coalesce(p.diff_preview, '-') AS diff_preview, CAST(coalesce(s.critical, 0) AS bigint) AS critical FROM {_CORE} c
LEFT JOIN {_PREVIEW} p ON p.repo_id = c.repo_id
LEFT JOIN (SELECT repo_id, count(*) FILTER (WHERE severity = 'critical') AS critical FROM {{ISSUES}} i GROUP BY repo_id) s ON s.repo_id = c.repo_id)"""


def _flat(report: DataFrame) -> list:
    return [
        "repo_id", F.col("repo_name").alias("name"), F.coalesce("health.before", F.lit(-1)).alias("before"), "health.after",
        *[f"issues.{c}" for c in ("total", "fixed", "remaining", "approved", "fix_rate_pct")],
        *[f"fixes.{c}" for c in ("total_jobs", "succeeded", "failed")],
        F.coalesce("tests.tests_total", F.lit(-1)).alias("tests_total"),
        F.coalesce("fixes.diff_preview", F.lit("-")).alias("diff_preview"),
        F.col("issues.severity_breakdown")["critical"]["total"].alias("critical"),
    ]


@query(f"SELECT r.* REPLACE (coalesce(before, -1) AS before) FROM {_REPORT} r")
def repo_report(t: Tables) -> DataFrame:
    report = RP.repo_report(t.repos, t.issues, t.jobs, t.runs)
    return report.select(*_flat(report))


@query(f"""
SELECT r.* REPLACE (coalesce(before, -1) AS before), coalesce(open_ids, '') AS open_ids, coalesce(fixed_ids, '') AS fixed_ids FROM {_REPORT} r
LEFT JOIN (SELECT repo_id, string_agg(issue_id, ' ' ORDER BY detected_at, issue_id) FILTER (WHERE status = 'open') AS open_ids,
  string_agg(issue_id, ' ' ORDER BY detected_at, issue_id) FILTER (WHERE status = 'fixed') AS fixed_ids
  FROM {{ISSUES}} i WHERE status IN ('open', 'fixed') GROUP BY repo_id) x ON x.repo_id = r.repo_id
""")
def report_documents(t: Tables) -> DataFrame:
    """Reports and their issue lists stored as documents and rows and read back. Only the ids that the
    result has in one row per repository are put together."""
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/reports-{uuid4().hex}"
    report, refs = RP.repo_report(t.repos, t.issues, t.jobs, t.runs), RP.issue_refs(t.issues)
    RP.store_reports(report, refs, path)
    reports, rows = RP.read_reports(t.spark, path, report.schema, refs.schema)

    def ids(name: str) -> Column:
        placed = F.sort_array(F.collect_list(F.when(F.col("list") == name, F.struct("position", "issue_id"))))
        return F.array_join(F.transform(placed, lambda x: x["issue_id"]), " ").alias(f"{name}_ids")

    lists = rows.groupBy("repo_id").agg(ids("open"), ids("fixed"))
    return reports.select(*_flat(report)).join(lists, "repo_id", "left").fillna("", ["open_ids", "fixed_ids"])


@query(f"""
SELECT p.issue_id, i.repo_id, p.prompt, 'pending' AS status, 1 AS attempt_number, 'approved' AS issue_status
FROM {_PROMPT} p JOIN {{ISSUES}} i ON i.issue_id = p.issue_id WHERE i.status <> 'fixed'
""")
def approved_jobs(t: Tables) -> DataFrame:
    """Approving all issues: fix jobs with their prompts, and the issues' new status."""
    issues = t.full_issues.join(t.issues.select("issue_id", "repo_id", "status"), "issue_id")
    jobs, approved = R.to_fix_jobs(issues)
    return jobs.join(approved.select("issue_id", F.col("status").alias("issue_status")), "issue_id").select(
        "issue_id", "repo_id", "prompt", "status", "attempt_number", "issue_status"
    )


@query("""
SELECT job_id, issue_id, repo_id, status, coalesce(diff, '-') AS diff, strftime(completed_at, '%Y-%m-%dT%H:%M:%S') AS completed_at FROM {JOBS} j
""")
def job_view(t: Tables) -> DataFrame:
    none = {c: F.lit(None) for c in ("attempt_number", "output", "started_at")}
    rows = I.job_view(t.jobs.withColumns(none).withColumn("started_at", F.col("started_at").cast("timestamp")))
    return rows.select("job_id", "issue_id", "repo_id", "status", "diff", "completed_at").fillna("-", ["diff"])


@query(f"""
SELECT run_id, repo_id, coalesce(job_id, '-') AS job_id, p + f > 0 AND f = 0 AS passed, p + f AS tests_total, p AS tests_passed, f AS tests_failed,
  strftime(ran_at, '%Y-%m-%dT%H:%M:%S') AS ran_at FROM {_LOG} l
""")
def run_view(t: Tables) -> DataFrame:
    return I.run_view(R.parse_runs(t.runs)).drop("output").fillna("-", ["job_id"])


_LAST_STATE = "SELECT job_id, seq, status FROM {STATUS_LOG} l QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1"


@query(_LAST_STATE)
def latest_state(t: Tables) -> DataFrame:
    return LC.latest_state(t.status_log, "job_id").select("job_id", "seq", "status")


@query(_LAST_STATE)
def compacted_state(t: Tables) -> DataFrame:
    """The log in four appends in no order of time, compacted after the second, and after the third where two came."""
    rows = t.status_log
    log = StateLog(t.spark, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/log-{uuid4().hex}", rows.schema, "job_id", buckets=8)
    for number in range(4):
        log.append(rows.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == number), number)
        if number in (1, 2):
            log.compact(min_appends=number)
    log.forget()
    return log.latest().select("job_id", "seq", "status")


_MOVES = "(SELECT job_id, seq, lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS from_status, status FROM {STATUS_LOG} l)"


@query(f"SELECT job_id, seq, coalesce(from_status, '-') AS from_status, status FROM {_MOVES} m")
def status_transitions(t: Tables) -> DataFrame:
    return LC.status_transitions(t.status_log, "job_id").drop("ts").fillna("-", ["from_status"])


@query(f"""
SELECT job_id, seq, from_status, status FROM {_MOVES} m WHERE from_status IS NOT NULL
  AND (from_status, status) NOT IN (('pending', 'running'), ('failed', 'running'), ('running', 'succeeded'), ('running', 'failed'))
""")
def illegal_transitions(t: Tables) -> DataFrame:
    return LC.illegal_transitions(t.status_log, "job_id").drop("ts")


@query("""
SELECT i.issue_id, CASE WHEN j.issue_id IS NOT NULL THEN 'fixed' ELSE i.status END AS status FROM {ISSUES} i
LEFT JOIN (SELECT DISTINCT issue_id FROM {JOBS} j WHERE status = 'succeeded') j ON j.issue_id = i.issue_id
""")
def issue_status_after_jobs(t: Tables) -> DataFrame:
    return R.issue_status_after_jobs(t.issues, t.jobs).select("issue_id", "status")


@query(f"""
SELECT job_id, CAST(coalesce(arg_max(CASE WHEN event = 'done' THEN 100 ELSE pct END, seq) FILTER (WHERE event IN ('progress', 'done')), 5) AS int) AS pct,
  coalesce(arg_max(CASE WHEN event = 'done' THEN 'Analysis complete!' ELSE message END, seq) FILTER (WHERE event IN ('progress', 'done')), {literal(folds.START_MESSAGE)}) AS message,
  {_count_if("event = 'issue_found'")} AS issues, NOT bool_or(event IN ('done', 'error')) AS running,
  coalesce(arg_max(message, seq) FILTER (WHERE event = 'error'), '-') AS error FROM {{EVENTS}} e GROUP BY job_id
""")
def progress_fold(t: Tables) -> DataFrame:
    return folds.progress_fold(t.events).fillna("-", ["error"])


@query("""
SELECT m.seq AS sent, CASE WHEN event IN ('error', 'done') THEN 'raw' ELSE event END AS event, CASE WHEN event IN ('error', 'done') THEN '-' ELSE job_id END AS job_id,
  CASE WHEN event IN ('error', 'done') THEN -1 ELSE pct END AS pct, CASE WHEN event IN ('error', 'done') THEN value ELSE message END AS text
FROM {MESSAGES} m JOIN {EVENTS} e ON e.seq = m.seq
""")
def parse_messages(t: Tables) -> DataFrame:
    sent = t.messages.select(F.col("seq").alias("sent"), "value")
    return parse_events(sent).select(
        "sent", "event", F.coalesce("job_id", F.lit("-")).alias("job_id"), F.coalesce("pct", F.lit(-1)).alias("pct"),
        F.coalesce("line", "message").alias("text"),
    )


@query("""
WITH e AS (SELECT * FROM {FIX_EVENTS} e), x AS (SELECT job_id, min(seq) AS seq FROM e WHERE event <> 'output' GROUP BY job_id),
  t AS (SELECT e.* FROM e JOIN x ON x.seq = e.seq), n AS (SELECT e.job_id, CAST(count(*) FILTER (WHERE event = 'output' AND (x.seq IS NULL OR e.seq < x.seq)) AS bigint) AS lines
    FROM e LEFT JOIN x ON x.job_id = e.job_id GROUP BY e.job_id)
SELECT n.job_id, CASE t.event WHEN 'fix_complete' THEN 'succeeded' WHEN 'fix_failed' THEN 'failed' ELSE CASE WHEN lines > 0 THEN 'running' ELSE 'pending' END END AS status, lines,
  CASE WHEN t.event = 'fix_complete' THEN t.diff ELSE '-' END AS diff, CASE WHEN t.event = 'fix_failed' THEN t.message ELSE '-' END AS error FROM n LEFT JOIN t ON t.job_id = n.job_id
""")
def fix_fold(t: Tables) -> DataFrame:
    return folds.fix_fold(t.fix_events).fillna("-", ["diff", "error"])


@query("""
WITH s AS (SELECT job_id, min(ts) AS started, min(ts) FILTER (WHERE event IN ('done', 'error')) AS ended FROM {EVENTS} e GROUP BY job_id),
  n AS (SELECT max(ts) AS now FROM {EVENTS} e)
SELECT job_id, (ended IS NULL OR ended > started + INTERVAL 122 SECOND) AND now > started + INTERVAL 122 SECOND AS timed_out FROM s, n
""")
def job_timeouts(t: Tables) -> DataFrame:
    return folds.job_timeouts(t.events).select("job_id", "timed_out")


@query("""
WITH g AS (SELECT job_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM {EVENTS} e WINDOW w AS (PARTITION BY job_id ORDER BY ts)),
  s AS (SELECT job_id, ts, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts) AS n FROM g)
SELECT job_id, min(ts) AS first, max(ts) AS last, CAST(count(*) AS bigint) AS events FROM s GROUP BY job_id, n
""")
def activity_sessions(t: Tables) -> DataFrame:
    """Runs of a job's events without a pause of six hours."""
    return SS.activity_sessions(t.events, gap_seconds=6 * 3600)


@query(f"SELECT repo_id, severity, {_N} AS issues FROM {{ISSUES}} i GROUP BY repo_id, severity")
def live_counts(t: Tables) -> DataFrame:
    return folds.live_counts(t.issues)


@query("SELECT issue_id, repo_id, severity, status, title, '-' AS description FROM {ISSUES} i")
def workflow_tables(t: Tables) -> DataFrame:
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/issues-{uuid4().hex}"
    append_table(t.issues, path, schemas.ISSUES, buckets=8)
    rows = read_table(t.spark, path, schemas.ISSUES)
    return rows.select("issue_id", "repo_id", "severity", "status", "title", F.coalesce("description", F.lit("-")).alias("description"))


@query("""
SELECT repo_id, 'j1' AS job_id, CASE WHEN CAST(substr(repo_id, 2) AS int) % 3 = 0 THEN CAST(substr(repo_id, 2) AS int) ELSE -1 END AS file_count FROM {SCANNED} s
""")
def metadata_with_job(t: Tables) -> DataFrame:
    """Scan metadata after an analysis began: the job's id is set, what was there stays if it was JSON."""
    field = lambda name: F.get_json_object("scan_metadata", f"$.{name}")
    return I.metadata_with_job(t.scanned, F.lit("j1")).select(
        "repo_id", field("analysis_job_id").alias("job_id"), F.coalesce(field("file_count").cast("int"), F.lit(-1)).alias("file_count")
    )


_RUN_LOG = """
WITH n AS (SELECT repo_id, count(*) AS n FROM {ISSUES} i GROUP BY repo_id),
  r AS (SELECT repo_id, coalesce(n, 0) AS n, tech_stack IN ('python', 'unknown') AS py, tech_stack <> 'python' AND tech_stack <> 'go' AS js FROM {REPOS} r LEFT JOIN n USING (repo_id)),
  h AS (SELECT *, 3 + CASE WHEN py THEN 2 ELSE 0 END + CASE WHEN js THEN 1 ELSE 0 END AS head FROM r),
  p AS (SELECT i.*, row_number() OVER (PARTITION BY repo_id ORDER BY detected_at, issue_id) AS k FROM {ISSUES} i),
  e AS (
    SELECT repo_id, 1 AS seq, 'progress' AS event, 'starting' AS step, 5 AS pct, 'Starting analysis...' AS message, NULL AS total, NULL AS issue FROM h
    UNION ALL SELECT repo_id, 2, 'progress', 'python_scan', 15, 'Scanning Python files...', NULL, NULL FROM h WHERE py
    UNION ALL SELECT repo_id, 3, 'progress', 'missing_tests', 35, 'Checking test coverage...', NULL, NULL FROM h WHERE py
    UNION ALL SELECT repo_id, head - 2, 'progress', 'js_scan', 45, 'Scanning JS/TS files...', NULL, NULL FROM h WHERE js
    UNION ALL SELECT repo_id, head - 1, 'progress', 'dedup', 55, concat('Found ', n, ' raw issues. Deduplicating...'), NULL, NULL FROM h
    UNION ALL SELECT repo_id, head, 'progress', 'root_cause', 60, 'Assistant is analyzing root causes...', NULL, NULL FROM h
    UNION ALL SELECT repo_id, head + 2 * k - 1, 'progress', 'root_cause', 60 + floor((k - 1) / n * 30), concat('Assistant analyzing issue ', k, '/', n, ': ', title), NULL, NULL
      FROM p JOIN h USING (repo_id)
    UNION ALL SELECT repo_id, head + 2 * k, 'issue_found', NULL, NULL, NULL, NULL, concat_ws('|', issue_id, severity, category, title, file_path, line_number) FROM p JOIN h USING (repo_id)
    UNION ALL SELECT repo_id, head + 2 * n + 1, 'progress', 'scoring', 92, 'Computing health score...', NULL, NULL FROM h
    UNION ALL SELECT repo_id, head + 2 * n + 2, 'done', NULL, NULL, NULL, n, NULL FROM h)
SELECT repo_id, CAST(seq AS bigint) AS seq, event, coalesce(step, '-') AS step, CAST(coalesce(pct, -1) AS int) AS pct, coalesce(message, '-') AS message,
  CAST(coalesce(total, -1) AS bigint) AS total_issues, coalesce(issue, '-') AS issue FROM e
"""


@query(_RUN_LOG)
def run_log(t: Tables) -> DataFrame:
    """The events of a run over every repository; its issues are taken for the raw ones too."""
    runs = t.repos.join(t.issues.groupBy("repo_id").agg(F.count("*").alias("raw")), "repo_id", "left")
    issue = F.concat_ws("|", "issue.id", "issue.severity", "issue.category", "issue.title", "issue.file_path", F.col("issue.line_number").cast("string"))
    events = runlog.run_events(runs, t.issues)
    return events.withColumn("issue", F.when(F.col("issue").isNull(), "-").otherwise(issue)).fillna("-", ["step", "message"]).fillna(-1, ["pct", "total_issues"])


@query(f"""
SELECT r.repo_id, name, status, tech_stack, CAST(greatest(0, 100 - coalesce(points, 0)) AS int) AS health_score_before
FROM {{REPOS}} r LEFT JOIN (SELECT repo_id, sum(CASE severity {" ".join(f"WHEN '{s}' THEN {n}" for s, n in K.PENALTIES.items())} ELSE 0 END) AS points FROM {{ISSUES}} i GROUP BY repo_id) p USING (repo_id)
""")
def scored_repositories(t: Tables) -> DataFrame:
    """Repositories as a run leaves them, stored and read back."""
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/repositories-{uuid4().hex}"
    append_table(runlog.score_repositories(t.repos, t.issues), path, schemas.REPOSITORIES, buckets=8)
    return read_table(t.spark, path, schemas.REPOSITORIES).select("repo_id", "name", "status", "tech_stack", "health_score_before")
