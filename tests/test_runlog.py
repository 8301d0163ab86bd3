"""The log of a run against a plain loop over its issues."""

from repolens.plans import runlog


def test_as_a_loop_over_the_issues(spark):
    stacks = {"a": "python", "b": "javascript", "c": "unknown", "d": None, "e": "go", "none": "typescript", "big": "python"}
    counts = {"a": 3, "b": 1, "c": 2, "d": 4, "e": 1, "none": 0, "big": 700, "stray": 5}
    issues = [(f"{r}{i:04}", r, "low", "bug", None if i == 1 else f"T {i} 100%", "f.py", i) for r, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(issues, "issue_id string, repo_id string, severity string, category string, title string, file_path string, line_number int").repartition(5)
    runs = spark.createDataFrame([(r, s, None if r == "none" else 2 * counts[r]) for r, s in stacks.items()], "repo_id string, tech_stack string, raw long")
    expected = []
    for repo, stack in stacks.items():
        log = [("progress", "starting", 5, "Starting analysis...", None, None)]
        if stack in ("python", "unknown", None):
            log += [("progress", "python_scan", 15, "Scanning Python files...", None, None), ("progress", "missing_tests", 35, "Checking test coverage...", None, None)]
        if stack in ("javascript", "typescript", "unknown", None):
            log += [("progress", "js_scan", 45, "Scanning JS/TS files...", None, None)]
        mine, n = [i for i in issues if i[1] == repo], counts[repo]
        log += [("progress", "dedup", 55, f"Found {2 * n} raw issues. Deduplicating...", None, None), ("progress", "why", 60, "50% AI is analyzing root causes...", None, None)]
        for k, (id_, _, severity, category, title, path, line) in enumerate(mine):
            log.append(("progress", "why", 60 + int(k / n * 30), f"50% AI analyzing issue {k + 1}/{n}: {title or ''}", None, None))
            log.append(("issue_found", None, None, None, None, (id_, severity, category, title, path, line)))
        log += [("progress", "scoring", 92, "Computing health score...", None, None), ("done", None, None, None, n, None)]
        expected += [(repo, seq, *e) for seq, e in enumerate(log, 1)]
    got = runlog.run_events(runs, df, order=["issue_id"], step="why", helper="50% AI").collect()
    rows = [(r.repo_id, r.seq, r.event, r.step, r.pct, r.message, r.total_issues, tuple(r.issue) if r.issue else None) for r in got]
    assert sorted(rows, key=lambda r: r[:2]) == sorted(expected, key=lambda r: r[:2])
    assert runlog.run_events(runs.limit(0), df, order=["issue_id"]).collect() == []


def test_scores_are_kept(spark):
    repos = spark.createDataFrame([("a", 7), ("b", None)], "repo_id string, health_score_before int")
    issues = spark.createDataFrame([("a", "critical"), ("a", "low"), ("a", "odd"), ("x", "low")], "repo_id string, severity string")
    rows = runlog.score_repositories(repos, issues).select("repo_id", "health_score_before", "health_score_after").collect()
    assert sorted(map(tuple, rows)) == [("a", 77, None), ("b", 100, None)]


def test_events_of_issues_are_one_join(spark):
    """A task that makes events of issues counts nothing again: issues meet the written rows of their runs."""
    issues = spark.createDataFrame([("i", "a", "low", "bug", "T", "f", 1)], "issue_id string, repo_id string, severity string, category string, title string, file_path string, line_number int")
    runs = spark.createDataFrame([("a", "go", 1)], "repo_id string, tech_stack string, raw long")
    plan = runlog.run_events(runs, issues, order=["issue_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan
