"""Code corpora and workflow tables derived from the given tables.

The given tables hold no source code, so these statements make repositories out of documents, and
workflow rows out of the other tables. Each is plain SQL with the same meaning in Spark and in other
engines, and keeps every row. A name after ``$`` is a given table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CORPUS = """
SELECT source AS repo_id, doc_id,
  CASE WHEN doc_id % 4 = 3 THEN concat('web/m', doc_id, '.js')
       WHEN doc_id % 6 = 4 THEN concat('pkg/tests/test_m', doc_id, '.py')
       ELSE concat('src/', lang, '/m', doc_id, '.py') END AS path,
  CASE WHEN doc_id % 4 = 3 THEN concat(
         'el.innerHTML = x;', chr(10),
         CASE WHEN doc_id % 5 = 0 THEN concat('const r = eval(q);', chr(10)) ELSE '' END,
         CASE WHEN doc_id % 7 = 0 THEN concat('document.write(q);', chr(10)) ELSE '' END,
         CASE WHEN doc_id % 3 = 0 THEN concat('const c = { api_key: "k', doc_id, 'zz" };', chr(10)) ELSE '' END,
         '// ', replace(text, chr(10), concat(chr(10), '// ')))
       WHEN doc_id % 6 = 4 THEN concat(
         'def test_f', doc_id + 20, '():', chr(10), '    assert True', chr(10),
         '# ', replace(text, chr(10), concat(chr(10), '# ')))
       ELSE concat(
         'import os', chr(10),
         CASE WHEN doc_id % 2 = 0 THEN concat('print(os.getcwd())', chr(10)) ELSE '' END,
         CASE WHEN doc_id % 3 = 0 THEN concat('API_KEY = "k', doc_id, 'zz"', chr(10)) ELSE '' END,
         CASE WHEN doc_id % 5 = 0 THEN concat('def f', doc_id, '(x):', chr(10), '    return eval(x)', chr(10)) ELSE '' END,
         CASE WHEN doc_id % 7 = 0 THEN concat('import subprocess', chr(10), 'subprocess.run(cmd, shell=True)', chr(10)) ELSE '' END,
         CASE WHEN doc_id % 9 = 0 THEN concat('def r', doc_id, '():', chr(10), '    try:', chr(10), '        pass', chr(10), '    except:', chr(10), '        pass', chr(10)) ELSE '' END,
         CASE WHEN doc_id % 10 = 1 THEN concat('def g', doc_id, '():', chr(10), '    tmp = 1', chr(10), '    return 42', chr(10)) ELSE '' END,
         CASE WHEN doc_id % 17 = 0 THEN concat('def broken(', chr(10)) ELSE '' END,
         '# ', replace(text, chr(10), concat(chr(10), '# '))) END AS content
FROM $documents
"""

# The same corpus after a change of every shell call; some files have moved.
CORPUS_AFTER = f"""
SELECT repo_id, doc_id, CASE WHEN doc_id % 13 = 0 THEN concat('moved/', path) ELSE path END AS path,
  replace(content, 'shell=True', 'shell=False') AS content FROM ({CORPUS}) c
"""

# What the analysis must find in the corpus, from the conditions its snippets are put in under: p, s,
# e, h, r and g are the numbers of lines the snippets before the place in question take.
_SNIPPETS = """
SELECT doc_id, source AS repo_id, doc_id % 4 = 3 AS js, doc_id % 6 = 4 AS test, doc_id % 17 = 0 AS broken,
  CASE WHEN doc_id % 4 = 3 THEN concat('web/m', doc_id, '.js') WHEN doc_id % 6 = 4 THEN concat('pkg/tests/test_m', doc_id, '.py')
       ELSE concat('src/', lang, '/m', doc_id, '.py') END AS path,
  CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS p, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS s,
  CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS e, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END AS h,
  CASE WHEN doc_id % 9 = 0 THEN 5 ELSE 0 END AS r, CASE WHEN doc_id % 10 = 1 THEN 3 ELSE 0 END AS g
FROM $documents
"""
_CODE = f"SELECT * FROM ({_SNIPPETS}) x WHERE NOT js AND NOT test AND NOT broken"
_DEFS = f"""
SELECT repo_id, path, concat('f', doc_id) AS name, 1 + p + s + 1 AS line FROM ({_CODE}) c WHERE e > 0 UNION ALL
SELECT repo_id, path, concat('r', doc_id), 1 + p + s + e + h + 1 FROM ({_CODE}) c WHERE r > 0 UNION ALL
SELECT repo_id, path, concat('g', doc_id), 1 + p + s + e + h + r + 1 FROM ({_CODE}) c WHERE g > 0
"""
_TESTED = f"SELECT repo_id, concat('f', doc_id + 20) AS name FROM ({_SNIPPETS}) x WHERE NOT js AND test"
EXPECTED_FINDINGS = f"""
SELECT repo_id, path AS file_path, 1 + p + s + e + h + r + g + 1 AS line_number, 'bug' AS category, 'high' AS severity, 'Syntax Error' AS title, 'def broken(' AS evidence
  FROM ({_SNIPPETS}) x WHERE NOT js AND NOT test AND broken UNION ALL
SELECT repo_id, path, 1, 'code_quality', 'low', 'Unused Import', 'import os' FROM ({_CODE}) c WHERE p = 0 UNION ALL
SELECT repo_id, path, 1 + p + 1, 'security', 'critical', 'Hardcoded Secret Detected', 'API_KEY = "[REDACTED]"' FROM ({_CODE}) c WHERE s > 0 UNION ALL
SELECT repo_id, path, 1 + p + s + 2, 'security', 'high', 'Dangerous eval() Call', 'return eval(x)' FROM ({_CODE}) c WHERE e > 0 UNION ALL
SELECT repo_id, path, 1 + p + s + e + 2, 'security', 'high', 'Insecure subprocess shell=True', 'subprocess.run(cmd, shell=True)' FROM ({_CODE}) c WHERE h > 0 UNION ALL
SELECT repo_id, path, 1 + p + s + e + h + 4, 'bug', 'medium', 'Broad Exception Silenced', 'except:' FROM ({_CODE}) c WHERE r > 0 UNION ALL
SELECT repo_id, path, 1 + p + s + e + h + r + 2, 'code_quality', 'low', 'Unused Variable', 'tmp = 1' FROM ({_CODE}) c WHERE g > 0 UNION ALL
SELECT repo_id, path, line, 'missing_test', 'low', concat('No Test for ', chr(39), name, chr(39)), concat('def ', name, '(...)') FROM ({_DEFS}) d
  WHERE NOT EXISTS (SELECT 1 FROM ({_TESTED}) t WHERE t.repo_id = d.repo_id AND t.name = d.name) UNION ALL
SELECT repo_id, path, 1, 'security', 'medium', 'Potential XSS via innerHTML', 'el.innerHTML = x;' FROM ({_SNIPPETS}) x WHERE js UNION ALL
SELECT repo_id, path, 2, 'security', 'high', 'Dangerous eval() Usage', 'const r = eval(q);' FROM ({_SNIPPETS}) x WHERE js AND e > 0 UNION ALL
SELECT repo_id, path, CASE WHEN e > 0 THEN 3 ELSE 2 END, 'security', 'medium', 'document.write() Usage', 'document.write(q);' FROM ({_SNIPPETS}) x WHERE js AND h > 0 UNION ALL
SELECT repo_id, path, 2 + CASE WHEN e > 0 THEN 1 ELSE 0 END + CASE WHEN h > 0 THEN 1 ELSE 0 END, 'security', 'critical', 'Hardcoded Secret Detected', 'const c = {{ api_key: "[REDACTED]" }};'
  FROM ({_SNIPPETS}) x WHERE js AND s > 0
"""
CORPUS_ISSUES = f"""
SELECT concat(repo_id, ':', file_path, ':', line_number, ':', title) AS issue_id, repo_id, file_path, CAST(line_number AS int) AS line_number,
  category, severity, title, evidence FROM ({EXPECTED_FINDINGS}) f
"""

# The expected facts of the Python files of the corpus, as numbers per file and kind.
EXPECTED_FACTS = f"""
SELECT repo_id, path, kind, n FROM (
  SELECT repo_id, path, 'error' AS kind, 1 AS n FROM ({_SNIPPETS}) x WHERE NOT js AND NOT test AND broken UNION ALL
  SELECT repo_id, path, 'import', 1 + CASE WHEN h > 0 THEN 1 ELSE 0 END FROM ({_CODE}) c UNION ALL
  SELECT repo_id, path, 'use', p + CASE WHEN h > 0 THEN 1 ELSE 0 END FROM ({_CODE}) c UNION ALL
  SELECT repo_id, path, 'handler', CASE WHEN r > 0 THEN 1 ELSE 0 END FROM ({_CODE}) c UNION ALL
  SELECT repo_id, path, 'call', CASE WHEN e > 0 THEN 1 ELSE 0 END + CASE WHEN h > 0 THEN 1 ELSE 0 END FROM ({_CODE}) c UNION ALL
  SELECT repo_id, path, 'def', CASE WHEN e > 0 THEN 1 ELSE 0 END + CASE WHEN r > 0 THEN 1 ELSE 0 END + CASE WHEN g > 0 THEN 1 ELSE 0 END FROM ({_CODE}) c UNION ALL
  SELECT repo_id, path, 'def', 1 FROM ({_SNIPPETS}) x WHERE NOT js AND test UNION ALL
  SELECT repo_id, path, 'assign', CASE WHEN g > 0 THEN 1 ELSE 0 END FROM ({_CODE}) c) k WHERE n > 0
"""

# Issues that point at lines of the corpus, some at missing files and some at no line.
POINTERS = f"""
SELECT concat('x', doc_id) AS issue_id, repo_id, CASE WHEN doc_id % 11 = 0 THEN 'missing.py' ELSE path END AS file_path,
  CAST(doc_id % 5 AS int) AS line_number FROM ({CORPUS}) c
"""

PATHS = """
SELECT concat('r', c_custkey % 50) AS repo_id,
  CASE c_custkey % 9 WHEN 0 THEN concat('reqs/', c_custkey, '/requirements.txt') WHEN 1 THEN concat('src/a', c_custkey, '.py')
    WHEN 2 THEN concat('node_modules/x', c_custkey, '/lib.js') WHEN 3 THEN concat('web/app', c_custkey, '.min.js')
    WHEN 4 THEN concat('a/b/c/d/e/f/deep', c_custkey, '.go') WHEN 5 THEN concat('ui/p', c_custkey, '.TSX')
    WHEN 6 THEN concat('img/i', c_custkey, '.PNG') WHEN 7 THEN concat('lib', c_custkey, '/.env') ELSE concat('docs/d', c_custkey, '.md') END AS path,
  CAST(c_nationkey * 1000 + c_custkey AS bigint) AS size
FROM $customer
"""

MARKERS = """
SELECT concat('m', c_custkey) AS repo_id, m.path, m.content FROM $customer JOIN (
    SELECT 0 AS k, 'requirements.txt' AS path, 'flask' AS content UNION ALL SELECT 1, 'pyproject.toml', '[tool.pytest]' UNION ALL
    SELECT 2, 'package.json', '{"devDependencies":{"jest":"29"}}' UNION ALL SELECT 3, 'package.json', '{"devDependencies":{"vitest":"1"}}' UNION ALL
    SELECT 3, 'tsconfig.json', '{}' UNION ALL SELECT 4, 'package.json', '{"devDependencies":{"mocha":"10"}}' UNION ALL
    SELECT 5, 'pom.xml', '<project/>' UNION ALL SELECT 6, 'Cargo.toml', '[package]' UNION ALL SELECT 7, 'go.mod', 'module m' UNION ALL
    SELECT 8, 'a.rb', 'puts 1' UNION ALL SELECT 8, 'b.rb', 'puts 2' UNION ALL SELECT 8, 'c.py', 'x = 1' UNION ALL
    SELECT 9, 'LICENSE', 'text' UNION ALL SELECT 10, 'src/test/AppTest.java', 'class AppTest {}' UNION ALL
    SELECT 11, 'pytest.ini', '[pytest]' UNION ALL SELECT 11, 'package.json', '{}' UNION ALL SELECT 12, 'Gemfile', 'x' UNION ALL SELECT 12, 'setup.cfg', 'x') m
ON c_custkey % 13 = m.k
"""

MEMBERS = """
SELECT concat('z', c_custkey % 60, '.zip') AS archive, CAST(floor(c_custkey / 60) AS bigint) AS ord,
  CASE WHEN c_custkey % 60 < 20 THEN concat('proj/f', c_custkey, '.py') WHEN c_custkey % 60 < 40 THEN concat('d', c_custkey % 2, c_custkey % 7, '/f', c_custkey, '.py')
    WHEN c_custkey = 45 THEN '../evil.py' WHEN c_custkey = 46 THEN '/etc/passwd' WHEN c_custkey = 47 THEN 'a..b.py' ELSE concat('f', c_custkey, '.py') END AS member,
  c_custkey <> 48 AS crc_ok, CAST(CASE WHEN c_custkey % 60 = 49 THEN 104857601 ELSE 1000 END AS bigint) AS archive_bytes
FROM $customer
"""

REPOS = """
SELECT concat('r', c_custkey) AS repo_id, c_name AS name,
  CASE c_custkey % 6 WHEN 0 THEN 'cloning' WHEN 1 THEN 'ready' WHEN 2 THEN 'analyzing' WHEN 3 THEN 'error' WHEN 4 THEN 'scanning' ELSE 'ready' END AS status,
  CASE c_custkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'go' ELSE 'unknown' END AS tech_stack,
  CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 101 AS int) END AS health_score_before
FROM $customer
"""

ISSUES = """
SELECT concat('i', o_orderkey) AS issue_id, concat('r', cast(floor(o_orderkey / 4) AS bigint)) AS repo_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'info' END AS severity,
  CASE o_orderkey % 4 WHEN 0 THEN 'bug' WHEN 1 THEN 'code_quality' WHEN 2 THEN 'security' ELSE 'missing_test' END AS category,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'approved' ELSE 'fixed' END AS status,
  concat('src/f', o_custkey % 20, '.py') AS file_path, cast(o_custkey % 50 AS int) AS line_number,
  concat('Title ', o_custkey % 5) AS title, CAST(o_orderdate AS timestamp) AS detected_at FROM $orders
"""

JOBS = """
SELECT concat('j', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS job_id, concat('i', l_orderkey) AS issue_id, concat('r', cast(floor(l_orderkey / 4) AS bigint)) AS repo_id,
  CASE WHEN l_linestatus = 'F' THEN 'succeeded' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN l_linestatus = 'F' THEN concat('--- a/f', l_partkey, chr(10), '+++ b/f', l_partkey) END AS diff, CAST(l_shipdate AS timestamp) AS completed_at FROM $lineitem
"""

RUNS = """
SELECT concat('t', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS run_id, concat('r', cast(floor(l_orderkey / 4) AS bigint)) AS repo_id,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('j', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) END AS job_id,
  concat(CASE WHEN l_quantity > 5 THEN concat(cast(l_quantity AS int), ' passed') ELSE 'no tests ran' END,
         CASE WHEN l_linenumber % 3 = 0 THEN concat(', ', l_linenumber, ' failed') ELSE '' END,
         CASE WHEN l_linenumber % 5 = 0 THEN ', 1 error' ELSE '' END, ' in 0.42s') AS output, CAST(l_shipdate AS timestamp) AS ran_at FROM $lineitem
"""

EVENTS = """
SELECT concat('job', user_id) AS job_id, event_id AS seq, CAST(ts AS timestamp) AS ts,
  CASE event_type WHEN 'signup' THEN 'progress' WHEN 'view' THEN 'issue_found' WHEN 'click' THEN 'output' WHEN 'purchase' THEN 'done' ELSE 'error' END AS event,
  cast(floor(value % 100) AS int) AS pct, concat('line ', event_id) AS message FROM $events
"""

# The same events as messages; errors come as plain text.
MESSAGES = f"""
SELECT seq, CASE WHEN event = 'error' THEN concat('plain {{"seq":', seq, '}}') WHEN event = 'done' THEN concat('{{"event":"done"}} rest ', seq)
  ELSE concat('{{"event":"', event, '","job_id":"', job_id, '","seq":', seq, ',"pct":', pct, ',"message":"', message, '"}}') END AS value FROM ({EVENTS}) e
"""

# Events of fix jobs, and of short jobs: one job per 20 events.
FIX_EVENTS = """
SELECT concat('fix', cast(floor(event_id / 20) AS bigint)) AS job_id, event_id AS seq, CAST(ts AS timestamp) AS ts,
  CASE WHEN event_type = 'purchase' AND value > 40 THEN 'fix_complete' WHEN event_type = 'error' AND value > 40 THEN 'fix_failed' ELSE 'output' END AS event,
  concat('diff ', event_id) AS diff, concat('line ', event_id) AS message FROM $events
"""

# Events with the number of the arrival they come in: five of six days each, and some that come one or three late.
ARRIVING = f"""
SELECT e.*, CAST(least(4, floor((day(ts) - 1) / 6) + CASE WHEN seq % 10 = 3 THEN 1 WHEN seq % 25 = 7 THEN 3 ELSE 0 END) AS int) AS arrival FROM ({EVENTS}) e
"""

# Results of test runs among the output of jobs, and the fix jobs that FIX_EVENTS speak of.
TEST_EVENTS = """
SELECT CASE event_type WHEN 'purchase' THEN 'test_result' ELSE 'output' END AS event, concat('t', event_id) AS run_id, concat('r', user_id) AS repo_id,
  concat('job', user_id) AS fix_job_id, value > 50 AS passed, CAST(floor(value) AS int) + 2 AS tests_total, CAST(floor(value) AS int) AS tests_passed,
  2 AS tests_failed, CAST(ts AS timestamp) AS ts FROM $events
"""

FIXING = """
SELECT DISTINCT concat('fix', cast(floor(event_id / 20) AS bigint)) AS job_id, concat('i', cast(floor(event_id / 20) AS bigint)) AS issue_id FROM $events
"""

STATUS_LOG = """
SELECT concat('job', user_id) AS job_id, event_id AS seq, CAST(ts AS timestamp) AS ts,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'cancelled' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status
FROM $events
"""

URLS = """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('https://github.com/org', page_id, '/repo', page_id) WHEN 1 THEN concat(' https://github.com/org/digit', page_id, '.git/ ')
  WHEN 2 THEN url WHEN 3 THEN '   ' ELSE concat('http://github.com/owner', page_id) END AS url FROM $pages
"""

TEXTS = """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN concat('note {x} ', '{"root_cause": "c', conv_id, '"}') WHEN 1 THEN concat(role, ' {"a": {"b": ', turn, '}}') ELSE 'no json here' END AS text FROM $conversations
"""

# Issues as findings, each twice; the copy has a later seq and another description.
FINDINGS = f"""
SELECT repo_id, file_path, line_number, title, severity, category, 'first' AS description, CAST(substr(issue_id, 2) AS bigint) AS seq FROM ({ISSUES}) a
UNION ALL
SELECT repo_id, file_path, line_number, title, severity, category, 'copy', CAST(substr(issue_id, 2) AS bigint) + 1000000000 FROM ({ISSUES}) b
"""

# One request for issues per repository; some filters are empty or null.
REQUESTS = """
SELECT concat('q', c_custkey) AS request_id, concat('r', c_custkey) AS repo_id,
  CASE c_custkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN '' WHEN 2 THEN 'low' END AS severity,
  CASE c_custkey % 3 WHEN 0 THEN 'security' WHEN 1 THEN '' END AS category,
  CASE WHEN c_custkey % 7 = 0 THEN 'src/f3.py' ELSE '' END AS file_path
FROM $customer
"""

# Repositories with scan metadata: good, broken, absent, and hidden by an empty stack.
SCANNED = """
SELECT concat('r', c_custkey) AS repo_id, c_name AS name, 'ready' AS status, CAST(NULL AS varchar(10)) AS source_url,
  CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN NULL ELSE 'python' END AS tech_stack, 'pytest' AS test_framework, 'w' AS local_path,
  CASE c_custkey % 3 WHEN 0 THEN concat('{"file_count":', c_custkey, ',"total_size_bytes":', c_custkey * 1000, ',"language_counts":{"Python":', c_custkey % 9, '},"analysis_job_id":"a', c_custkey, '"}')
    WHEN 1 THEN '{"file_count": 1' END AS scan_metadata, CAST(c_custkey % 101 AS int) AS health_score_before
FROM $customer
"""

# Names of uploaded files.
UPLOADS = """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('proj', c_custkey, '.zip') WHEN 1 THEN concat('a.zip', c_custkey, '.zip') WHEN 2 THEN concat('B', c_custkey, '.ZIP')
  ELSE concat('c', c_custkey, '.tar') END AS file_name FROM $customer
"""

# Root causes kept as text: JSON, plain text, nothing.
CAUSES = """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('{"root_cause":"c', conv_id, '"}') WHEN 1 THEN concat('plain "', role, '" text') WHEN 2 THEN '' END AS text FROM $conversations
"""

# Issues with everything a fix request asks for.
FULL_ISSUES = f"""
SELECT issue_id, file_path, line_number, title, concat('About ', title, ' in ', file_path) AS description,
  CASE WHEN line_number % 3 = 0 THEN '' ELSE concat('x = ', line_number) END AS evidence,
  CASE WHEN line_number % 4 <> 0 THEN 'Do it' END AS suggested_fix,
  CASE line_number % 3 WHEN 0 THEN '{{"steps":["one","two"],"risk_level":"low"}}' WHEN 1 THEN 'no plan' END AS fix_plan
FROM ({ISSUES}) i
"""

# Stack of each repository of the corpus.
CORPUS_STACKS = """
SELECT source AS repo_id, CASE CAST(substr(source, 4) AS int) % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'go' END AS tech_stack
FROM $documents GROUP BY source
"""


# A thousand rules at most, each for the keys whose number ends in its three digits.
KEY_RULES = """
SELECT CASE WHEN n % 2 = 0 THEN 'py' ELSE 'js' END AS language,
  concat('(?i)api_key[ ]*[:=][ ]*"k([1-9][0-9]*', substr('00', 1, 3 - length(concat('', n))), ')?', n, 'zz"') AS pattern,
  'security' AS category, 'high' AS severity, concat('Key ', n) AS title, concat('Key of group ', n) AS description, 'Revoke it.' AS suggested_fix,
  CAST(0.5 AS double) AS confidence, n % 3 = 0 AS redact, '' AS first
FROM (SELECT DISTINCT doc_id % 1000 AS n FROM $documents) d
"""


def load(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """Run a statement over the parquet files of a folder."""
    return spark.sql(re.sub(r"\$(\w+)", rf"parquet.`{sf_dir.rstrip('/')}/\1.parquet`", statement))


def portable(statement: str) -> str:
    """The statement over tables registered under their own names."""
    return re.sub(r"\$(\w+)", r"\1", statement)
