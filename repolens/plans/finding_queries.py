"""Queries over findings of the derived corpus, and the rewrites that fix them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.operators import codemod as C
from repolens.operators import diffs as D
from repolens.operators import factrules as R
from repolens.operators import findings as FD
from repolens.operators.facts import extract_facts, fact_rows
from repolens.operators.lines import LINE_RULES, rules_from_table
from repolens.operators.ruleindex import apply_many_rules
from repolens.plans import analysis
from repolens.plans.registry import Tables, literal, query
from repolens.session import ensure_checkpoint_dir, materialize
from repolens.sources import layout

COLUMNS = ["repo_id", "file_path", "line_number", "category", "severity", "title", "evidence"]
_EXPECTED = "SELECT repo_id, file_path, CAST(line_number AS int) AS line_number, category, severity, title, evidence FROM {EXPECTED_FINDINGS} f"


def _facts(t: Tables) -> DataFrame:
    return extract_facts(FD.python_files(t.corpus))


@query("SELECT repo_id, path, kind, CAST(n AS bigint) AS n FROM {EXPECTED_FACTS} f")
def ast_facts(t: Tables) -> DataFrame:
    rows = fact_rows(_facts(t))
    return rows.groupBy("repo_id", "path", "kind").agg(F.count("*").alias("n"))


@query(f"{_EXPECTED} WHERE title = 'Syntax Error'")
def syntax_errors(t: Tables) -> DataFrame:
    return R.syntax_errors(_facts(t)).select(COLUMNS)


@query(f"{_EXPECTED} WHERE title = 'Unused Import'")
def unused_imports(t: Tables) -> DataFrame:
    return R.unused_imports(_facts(t)).select(COLUMNS)


@query(f"{_EXPECTED} WHERE title = 'Broad Exception Silenced'")
def broad_except(t: Tables) -> DataFrame:
    return R.broad_except(_facts(t)).select(COLUMNS)


@query(f"{_EXPECTED} WHERE title = 'Dangerous eval() Call'")
def eval_exec_calls(t: Tables) -> DataFrame:
    return R.eval_exec_calls(_facts(t)).select(COLUMNS)


@query(f"{_EXPECTED} WHERE title = 'Insecure subprocess shell=True'")
def shell_true_calls(t: Tables) -> DataFrame:
    return R.shell_true_calls(_facts(t)).select(COLUMNS)


@query(f"{_EXPECTED} WHERE title = 'Unused Variable'")
def unused_variables(t: Tables) -> DataFrame:
    return R.unused_variables(_facts(t)).select(COLUMNS)


@query(f"{_EXPECTED} WHERE category = 'missing_test'")
def untested_functions(t: Tables) -> DataFrame:
    return R.untested_functions(materialize(_facts(t), "facts")).select(COLUMNS)


# The line rules run on the lines themselves: (rule of the language, pattern in RE2 syntax).
_LINES = """(SELECT repo_id, path, CAST(i AS int) AS line_number, l[i] AS line FROM (SELECT repo_id, path, l, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT repo_id, path, string_split(content, chr(10)) AS l FROM {CORPUS} c) a) b)"""


def _line_rule_sql(language: str, suffix: str) -> str:
    rules = [r for r in LINE_RULES if r.language == language]
    redacting = """regexp_replace(trim(line), '(%s\\s*["''])[^"'']+(["''])', '\\1[REDACTED]\\2', 'g')""" % ("=" if language == "py" else "[=:]")
    code = "TRUE" if language == "py" else "trim(line) <> '' AND NOT starts_with(trim(line), '//') AND NOT starts_with(trim(line), '*')"
    return " UNION ALL ".join(
        f"SELECT repo_id, path AS file_path, line_number, {literal(r.category)} AS category, {literal(r.severity)} AS severity, "
        f"{literal(r.title)} AS title, {redacting if r.redact else 'trim(line)'} AS evidence, CAST({r.confidence} AS double) AS confidence "
        f"FROM lines WHERE path LIKE '%{suffix}' AND {code} AND regexp_matches(line, {literal(r.pattern)})"
        for r in rules
    )


@query(f"WITH lines AS MATERIALIZED {_LINES} {_line_rule_sql('js', '.js')}")
def js_line_rules(t: Tables) -> DataFrame:
    return FD.line_findings(t.corpus, [r for r in LINE_RULES if r.language == "js"]).select(*COLUMNS, "confidence")


@query(f"WITH lines AS MATERIALIZED {_LINES} {_line_rule_sql('py', '.py')}")
def py_secret_rule(t: Tables) -> DataFrame:
    return FD.line_findings(t.corpus, [r for r in LINE_RULES if r.language == "py"]).select(*COLUMNS, "confidence")


@query(f"""
WITH lines AS MATERIALIZED {_LINES}, keys AS (SELECT *, CAST(regexp_extract(line, '"k(\\d+)zz"', 1) AS bigint) % 1000 AS n FROM lines
  WHERE regexp_matches(line, '(?i)api_key[ ]*[:=][ ]*"k\\d+zz"') AND (path LIKE '%.py' OR NOT starts_with(trim(line), '//') AND NOT starts_with(trim(line), '*')))
SELECT repo_id, path AS file_path, line_number, 'security' AS category, 'high' AS severity, concat('Key ', n) AS title,
  CASE WHEN n % 3 = 0 THEN regexp_replace(trim(line), '"k\\d+zz"', '"[REDACTED]"') ELSE trim(line) END AS evidence
FROM keys WHERE path LIKE CASE WHEN n % 2 = 0 THEN '%.py' ELSE '%.js' END
""")
def many_line_rules(t: Tables) -> DataFrame:
    """A thousand rules kept as rows."""
    return apply_many_rules(t.corpus, rules_from_table(t.key_rules)).select(COLUMNS)


@query(_EXPECTED)
def all_findings(t: Tables) -> DataFrame:
    return FD.all_findings(t.corpus).select(COLUMNS)


@query(f"""
WITH f AS ({_EXPECTED}), c AS (SELECT count(*) AS n, sum(strlen(content)) AS size FROM {{CORPUS}} c)
SELECT CAST(c.n AS bigint) AS files, CAST(size AS bigint) AS bytes, CAST((SELECT count(*) FROM f WHERE title = 'Syntax Error') AS bigint) AS unparsed,
  CAST((SELECT count(*) FROM f) AS bigint) AS findings, CAST((SELECT count(*) FROM (SELECT DISTINCT repo_id, file_path, line_number, title FROM f)) AS bigint) AS distinct_findings FROM c
""")
def run_metrics(t: Tables) -> DataFrame:
    """What a run over the corpus saw, observed while its findings were written."""
    seen = FD.store_findings(t.corpus, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/run-{uuid4().hex}")
    row = (seen["files"], seen["bytes"], seen["unparsed"], seen["findings"], seen["distinct"])
    return t.spark.createDataFrame([row], "files long, bytes long, unparsed long, findings long, distinct_findings long")


@query("""
SELECT c.repo_id, c.path FROM {CORPUS} c JOIN {CORPUS_STACKS} s ON s.repo_id = c.repo_id
WHERE (path LIKE '%.py' AND coalesce(tech_stack, 'unknown') IN ('python', 'unknown'))
   OR (path LIKE '%.js' AND coalesce(tech_stack, 'unknown') IN ('javascript', 'typescript', 'unknown'))
""")
def dispatch_by_stack(t: Tables) -> DataFrame:
    return FD.dispatch(t.corpus.select("repo_id", "path"), t.corpus_stacks)


_PENALTY = "CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END"


@query(f"""
WITH f AS (SELECT DISTINCT repo_id, file_path, line_number, title, severity FROM {{EXPECTED_FINDINGS}} f)
SELECT r.repo_id, CAST(count(title) AS bigint) AS findings, {", ".join(f"CAST(count(*) FILTER (WHERE severity = '{s}') AS bigint) AS {s}" for s in K.SEVERITIES)},
  CAST(coalesce(sum({_PENALTY}), 0) AS bigint) AS penalty, CAST(greatest(0, 100 - coalesce(sum({_PENALTY}), 0)) AS int) AS health_score
FROM (SELECT DISTINCT source AS repo_id FROM documents) r LEFT JOIN f ON f.repo_id = r.repo_id GROUP BY r.repo_id
""")
def repo_health(t: Tables) -> DataFrame:
    return analysis.repo_health(t.corpus)


@query("SELECT repo_id, file_path, line_number, title, description, seq FROM {FINDINGS} f WHERE description = 'first' AND "
       "seq IN (SELECT min(seq) FROM {FINDINGS} g GROUP BY repo_id, file_path, line_number, title)")
def dedup_findings(t: Tables) -> DataFrame:
    return FD.dedup_findings(t.findings).select("repo_id", "file_path", "line_number", "title", "description", "seq")


@query("""
SELECT repo_id, CAST(sum(n) AS bigint) AS raw, CAST(count(*) AS bigint) AS deduplicated FROM
  (SELECT repo_id, file_path, line_number, title, count(*) AS n FROM {FINDINGS} f GROUP BY ALL) k GROUP BY repo_id
""")
def finding_counts(t: Tables) -> DataFrame:
    return FD.finding_counts(t.findings)


_CAUSE = "CASE category " + " ".join(f"WHEN '{c}' THEN {literal(cause)}" for c, (cause, _) in K.ROOT_CAUSES.items()) + " END"
_STRATEGY = "CASE category " + " ".join(f"WHEN '{c}' THEN {literal(fix)}" for c, (_, fix) in K.ROOT_CAUSES.items()) + " END"


@query(f"""
SELECT sha256(concat_ws(chr(1), 'run1', repo_id, file_path, line_number, title)) AS issue_id, 'run1' AS run_id, repo_id, file_path, CAST(line_number AS int) AS line_number,
  title, evidence, concat('{{"root_cause":"', {_CAUSE}, '","affected_lines":["', file_path, '"],"fix_strategy":"', {_STRATEGY}, '"}}') AS root_cause,
  concat('["', file_path, '"]') AS affected_files, 'open' AS status FROM {{EXPECTED_FINDINGS}} f
""")
def issue_sink(t: Tables) -> DataFrame:
    issues = analysis.analyze_to_issues(t.corpus, "run1")
    return issues.select(
        "issue_id", "run_id", "repo_id", "file_path", "line_number", "title", "evidence", "root_cause", "affected_files", "status"
    )


def _laid_out(t: Tables, files: DataFrame, buckets: int | None = None) -> DataFrame:
    name = f"corpus_{uuid4().hex}"
    return layout.write_laid_out(files, name, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/{name}", buckets)


_TARGETS = """
SELECT p.issue_id, p.repo_id, p.file_path, p.line_number, coalesce(CASE WHEN p.line_number > 0 AND p.line_number <= len(l) - CASE WHEN l[len(l)] = '' THEN 1 ELSE 0 END
  THEN l[p.line_number] END, '-') AS target FROM {POINTERS} p JOIN (SELECT repo_id, path, string_split(content, chr(10)) AS l FROM {CORPUS} c) c
  ON c.repo_id = p.repo_id AND c.path = p.file_path
"""


@query(_TARGETS)
def targets_laid_out(t: Tables) -> DataFrame:
    """Issues meet a corpus in buckets of its key."""
    return C.issue_targets(t.pointers, _laid_out(t, t.corpus), laid_out=True).fillna("-", ["target"])


@query(_TARGETS)
def issue_targets(t: Tables) -> DataFrame:
    return C.issue_targets(t.pointers, t.corpus).fillna("-", ["target"])


def _rewrites(t: Tables, files: DataFrame, *titles: str) -> DataFrame:
    issues = t.corpus_issues
    if titles:
        issues = issues.where(F.col("title").isin(*titles))
    rows = C.apply_codemods(issues, files)
    return rows.select("repo_id", "path", F.md5("before").alias("before"), F.md5("after").alias("after"), "applied")


def _rewrite_sql(title: str, after: str, files: str = "{CORPUS}") -> str:
    """Expected texts: ``after`` is computed from ``content``; all conditions are those of the snippets."""
    return (
        f"SELECT c.repo_id, c.path, md5(content) AS before, md5({after}) AS after, content <> {after} AS applied FROM {files} c "
        f"JOIN (SELECT DISTINCT repo_id, file_path FROM {{EXPECTED_FINDINGS}} f WHERE title IN ({literal(title)})) i "
        "ON i.repo_id = c.repo_id AND i.file_path = c.path"
    )


# In scripts no line is a bare assignment and no name is a well-known one, so they stay as they are.
_SECRET_FIXED = """CASE WHEN path LIKE '%.py' THEN replace(content, concat('API_KEY = "k', doc_id, 'zz"'),
  'API_KEY = os.environ.get("API_KEY", "")  # autofix') ELSE content END"""
_IMPORT_FIXED = "regexp_replace(content, '^import os\\n', '# import os  # autofix: removed unused import\\n')".replace("\\n", "' || chr(10) || '", 1).replace(
    "\\n", "' || chr(10) || '"
)
_SHELL_FIXED = "replace(content, 'subprocess.run(cmd, shell=True)', 'subprocess.run(cmd, shell=False)')"
_VARIABLE_FIXED = "replace(content, chr(10) || '    tmp = 1', chr(10) || '    _tmp = 1')"
_EXCEPT_FIXED = "replace(content, chr(10) || '    except:' || chr(10), chr(10) || '    except Exception:  # autofix' || chr(10))"
_EVAL_CORPUS = "(SELECT repo_id, doc_id, path, replace(content, 'return eval(x)', 'return eval(expr)') AS content FROM {CORPUS} c)"
_EVAL_FIXED = "replace(content, 'return eval(expr)', 'import ast' || chr(10) || '    return ast.literal_eval(expr)  # autofix')"


@query(_rewrite_sql("Hardcoded Secret Detected", _SECRET_FIXED))
def codemod_secret(t: Tables) -> DataFrame:
    return _rewrites(t, t.corpus, "Hardcoded Secret Detected")


@query(_rewrite_sql("Dangerous eval() Call", _EVAL_FIXED, _EVAL_CORPUS))
def codemod_eval(t: Tables) -> DataFrame:
    files = t.corpus.withColumn("content", F.replace("content", F.lit("return eval(x)"), F.lit("return eval(expr)")))
    return _rewrites(t, files, "Dangerous eval() Call")


@query(_rewrite_sql("Insecure subprocess shell=True", _SHELL_FIXED))
def codemod_shell(t: Tables) -> DataFrame:
    return _rewrites(t, t.corpus, "Insecure subprocess shell=True")


@query(_rewrite_sql("Unused Import", _IMPORT_FIXED))
def codemod_import(t: Tables) -> DataFrame:
    return _rewrites(t, t.corpus, "Unused Import")


@query(_rewrite_sql("Unused Variable", _VARIABLE_FIXED))
def codemod_variable(t: Tables) -> DataFrame:
    return _rewrites(t, t.corpus, "Unused Variable")


@query(_rewrite_sql("Broad Exception Silenced", _EXCEPT_FIXED))
def codemod_except(t: Tables) -> DataFrame:
    return _rewrites(t, t.corpus, "Broad Exception Silenced")


@query("""
SELECT repo_id, concat('tests/test_', replace(file_path, '/', '_'), '_stubs.py') AS path, concat('# autofix: generated stub tests', chr(10), string_agg(
  concat('def test_', name, '_stub():', chr(10), '    \"""Stub test for ', name, ' — fill in real assertions.\"""', chr(10), '    pass', chr(10)), chr(10) || chr(10) ORDER BY name)) AS after
FROM (SELECT repo_id, file_path, substr(evidence, 5, length(evidence) - 9) AS name FROM {EXPECTED_FINDINGS} f WHERE category = 'missing_test') n GROUP BY repo_id, file_path
""")
def codemod_stub_tests(t: Tables) -> DataFrame:
    return C.stub_tests(t.corpus_issues)


_ALL_FIXED = "content"
for _step in (
    "CASE WHEN doc_id % 3 = 0 AND path LIKE '%.py' THEN {s} ELSE {c} END".replace(
        "{s}", "replace({c}, concat('API_KEY = \"k', doc_id, 'zz\"'), 'API_KEY = os.environ.get(\"API_KEY\", \"\")  # autofix')"),
    "CASE WHEN doc_id % 2 = 1 AND starts_with({c}, 'import os' || chr(10)) THEN '# import os  # autofix: removed unused import' || substr({c}, 10) ELSE {c} END",
    _VARIABLE_FIXED.replace("content", "{c}"),
    _SHELL_FIXED.replace("content", "{c}"),
    _EXCEPT_FIXED.replace("content", "{c}"),
):
    _ALL_FIXED = _step.replace("{c}", _ALL_FIXED)


_APPLIED = f"""
SELECT c.repo_id, c.path, md5(content) AS before, md5(fixed) AS after, content <> fixed AS applied FROM
  (SELECT repo_id, path, doc_id, content, {_ALL_FIXED} AS fixed FROM {{CORPUS}} c) c
JOIN (SELECT DISTINCT repo_id, file_path FROM {{EXPECTED_FINDINGS}} f WHERE (title LIKE '%Secret%' OR title LIKE '%eval%' OR title LIKE '%shell%' OR title LIKE 'Unused%'
  OR title LIKE 'Broad%') AND category <> 'missing_test') i ON i.repo_id = c.repo_id AND i.file_path = c.path
"""


@query(_APPLIED)
def codemod_applied(t: Tables) -> DataFrame:
    return _rewrites(t, t.corpus)


@query(_APPLIED)
def codemods_laid_out(t: Tables) -> DataFrame:
    """Edits meet a corpus in buckets of its key."""
    rows = C.apply_codemods(t.corpus_issues, _laid_out(t, t.corpus), laid_out=True)
    return rows.select("repo_id", "path", F.md5("before").alias("before"), F.md5("after").alias("after"), "applied")


_CHANGED = """(SELECT coalesce(b.repo_id, a.repo_id) AS repo_id, coalesce(b.path, a.path) AS path, b.content AS before, a.content AS after
  FROM {CORPUS} b FULL OUTER JOIN {CORPUS_AFTER} a ON a.repo_id = b.repo_id AND a.path = b.path WHERE b.content IS DISTINCT FROM a.content)"""


@query(f"SELECT repo_id, path, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'modified' END AS change FROM {_CHANGED} x")
def changed_files(t: Tables) -> DataFrame:
    return D.changed_files(t.corpus, t.corpus_after)


_DIFF_STAT = f"""
SELECT repo_id, path, CAST(CASE WHEN before IS NULL THEN len(string_split(after, chr(10))) WHEN after IS NULL THEN 0 ELSE 1 END AS bigint) AS added,
  CAST(CASE WHEN before IS NULL THEN 0 WHEN after IS NULL THEN len(string_split(before, chr(10))) ELSE 1 END AS bigint) AS removed FROM {_CHANGED} x
"""


@query(_DIFF_STAT)
def unified_diff(t: Tables) -> DataFrame:
    return D.diff_stat(D.snapshot_diff(t.corpus, t.corpus_after))


@query(_DIFF_STAT)
def diffs_laid_out(t: Tables) -> DataFrame:
    """Both snapshots in equally many buckets of their key."""
    buckets = layout.buckets_for(t.corpus)
    before, after = _laid_out(t, t.corpus, buckets), _laid_out(t, t.corpus_after, buckets)
    return D.diff_stat(D.snapshot_diff(before, after, laid_out=True))
