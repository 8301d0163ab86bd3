"""Rules over small sources: one case per behaviour, and a whole small repository."""

import pytest
from pyspark.sql import functions as F

from repolens.operators import factrules as R
from repolens.operators import findings as FD
from repolens.operators.facts import extract_facts, fact_rows, file_facts
from repolens.operators.health import health_score
from repolens.operators.lines import LINE_RULES, LineRule, apply_line_rules, rules_from_table
from repolens.plans.analysis import analyze, repo_health
from repolens.sqlaccess import register

PYTHON = {
    # source: (title, line) of every finding of the file-local rules
    "import os\nx = 1\n": [("Unused Import", 1)],
    "import os\nprint(os.getcwd())\n": [],
    "import os.path\nos.getcwd()\n": [],
    "import a.b as c\nc\n": [],
    "from m import *\n": [],
    "from m import a, _b\n": [("Unused Import", 1)],
    "import os\nimport os\n": [("Unused Import", 2)],
    "import os, sys\n": [("Unused Import", 1), ("Unused Import", 1)],
    "import os\nos = 1\n": [],
    "import os\n__all__ = ['os']\n": [("Unused Import", 1)],
    "from __future__ import annotations\n": [("Unused Import", 1)],
    "def f():\n    import os\n": [("Unused Import", 2)],
    "try:\n    x()\nexcept:\n    pass\n": [("Broad Exception Silenced", 3)],
    "try:\n    x()\nexcept Exception:\n    pass\n    pass\n": [("Broad Exception Silenced", 3)],
    "try:\n    x()\nexcept BaseException as e:\n    pass\n": [("Broad Exception Silenced", 3)],
    "try:\n    x()\nexcept ValueError:\n    pass\n": [],
    "try:\n    x()\nexcept (Exception, OSError):\n    pass\n": [],
    "try:\n    x()\nexcept m.Exception:\n    pass\n": [],
    "try:\n    x()\nexcept Exception:\n    y()\n": [],
    "try:\n    x()\nexcept* Exception:\n    pass\n": [],
    "eval(x)\n": [("Dangerous eval() Call", 1)],
    "exec(code)\n": [("Dangerous exec() Call", 1)],
    "df.eval(x)\n": [("Dangerous eval() Call", 1)],
    "eval('1 + 2')\n": [],
    "eval()\n": [("Dangerous eval() Call", 1)],
    "model().eval\n": [],
    "import subprocess\nsubprocess.run(c, shell=True)\n": [("Insecure subprocess shell=True", 2)],
    "p = Popen(c, shell=True)\n": [("Insecure subprocess shell=True", 1)],
    "runner.check_call(c, shell=True)\n": [("Insecure subprocess shell=True", 1)],
    "run(c, shell=False)\nrun(c, shell=1)\nrun(c, shell=flag)\nother(c, shell=True)\n": [],
    "def f():\n    tmp = 1\n    return 2\n": [("Unused Variable", 2)],
    "def f():\n    tmp = 1\n    return tmp\n": [],
    "def f():\n    _tmp = 1\n    a, b = 1, 2\n    c: int = 3\n    d.e = 4\n": [],
    "def f():\n    x = 1\n    x += 1\n": [("Unused Variable", 2)],
    "def f():\n    x = 1\n    x = 2\n": [("Unused Variable", 3)],
    "async def f():\n    a = b = 1\n": [("Unused Variable", 2), ("Unused Variable", 2)],
    "def f():\n    def g():\n        y = 1\n": [("Unused Variable", 3), ("Unused Variable", 3)],
    "def f():\n    y = 1\n    def g():\n        return y\n": [],
    "tmp = 1\n": [],
    "def broken(\n": [("Syntax Error", 1)],
    "\ufeffx = 1\n": [("Syntax Error", 1)],
    "x = 1\0\n": [("Syntax Error", 1)],
    "": [],
}


def test_file_local_rules(corpus):
    files = {f"f{i}.py": source for i, source in enumerate(PYTHON)}
    rows = FD.file_findings(extract_facts(corpus(files))).select("file_path", "title", "line_number").collect()
    for i, (source, expected) in enumerate(PYTHON.items()):
        got = sorted((r.title, r.line_number) for r in rows if r.file_path == f"f{i}.py")
        assert got == sorted(expected), source


def test_finding_fields(corpus):
    files = {"a.py": "import os, sys\ntry:\n    x()\nexcept:\n    pass\nq.eval(z)\ncall(y, shell=True)\ndef f():\n    v = 1\n"}
    rows = {(r.title, r.description): r for r in FD.file_findings(extract_facts(corpus(files))).collect()}
    os_import = rows["Unused Import", "'os' is imported but never used in this module."]
    assert (os_import.evidence, os_import.suggested_fix, os_import.confidence, os_import.severity) == (
        "import os, sys", "Remove the import of 'os' or use it.", 0.85, "low")
    titles = {t: r for (t, _), r in rows.items()}
    assert titles["Dangerous eval() Call"].suggested_fix == "Replace `eval()` with a safe alternative (e.g. ast.literal_eval for data)."
    assert titles["Insecure subprocess shell=True"].description.startswith("`subprocess.call(..., shell=True)` enables shell injection.")
    assert (titles["Unused Variable"].evidence, titles["Unused Variable"].confidence) == ("v = 1", 0.75)
    assert (titles["Broad Exception Silenced"].category, titles["Broad Exception Silenced"].evidence) == ("bug", "except:")


def test_a_parser_crash_is_a_fact(corpus):
    deep = "x = " + "(" * 100 + "1" + ")" * 100 + "\n" + "y = " + "-" * 200_000 + "1\n"
    assert file_facts(deep)["error"]["kind"] in ("parse_error", "syntax_error")
    facts = extract_facts(corpus({"deep.py": deep, "ok.py": "import os\n"}))
    assert [r.file_path for r in R.unused_imports(facts).collect()] == ["ok.py"]


def test_no_file_vanishes(corpus):
    """Valid code too deep for the parser has a row and keeps its line findings."""
    deep = "x = " + "+".join(["1"] * 200_000) + "\npassword = \"abcdefgh\"\n"
    assert file_facts(deep)["error"]["kind"] == "parse_error"
    rows = FD.all_findings(corpus({"deep.py": deep, "bad.py": "def f(:\npassword = \"abcdefgh\"\n"})).collect()
    assert sorted((r.file_path, r.title) for r in rows) == [
        ("bad.py", "Syntax Error"), ("deep.py", "File Not Parsed"), ("deep.py", "Hardcoded Secret Detected")]


def test_untested_functions(corpus):
    files = {
        "app.py": "def a(): pass\ndef b(): pass\nclass C:\n    def m(self):\n        def inner(): pass\ndef _p(): pass\ndef test_like(): pass\n"
                  "def d(): pass\nasync def e(): pass\ndef name(): pass\n",
        "pkg/tests/x.py": "def a(): pass\ndef test_e(): pass\n",
        "test_app.py": "def test_b_strings(): pass\ndef test_d(): pass\ndef test_test_name(): pass\n",
        "tests/conftest.py": "def helper(): pass\n",
        "bad.py": "def lost(:\n",
        "node_modules/v.py": "def vendored(): pass\n",
        "test_broken.py": "def test_b(:\n",
    }
    rows = R.untested_functions(extract_facts(corpus(files)))
    assert sorted(r.evidence for r in rows.collect()) == sorted(
        f"def {n}(...)" for n in ("b", "m", "inner", "test_like", "helper", "vendored"))
    skipped = R.untested_functions(extract_facts(corpus(files)), skip_vendored=True)
    assert "def vendored(...)" not in [r.evidence for r in skipped.collect()]
    first = rows.where("title = \"No Test for 'b'\"").first()
    assert first.description == "Function 'b' in app.py has no corresponding test."
    assert first.suggested_fix == "Add a test function named 'test_b' in the tests/ directory."


def test_tests_of_other_repositories_do_not_count(corpus):
    files = corpus({"one": {"a.py": "def f(): pass\n"}, "two": {"test_a.py": "def test_f(): pass\n"}})
    assert R.untested_functions(extract_facts(files)).count() == 1


SCRIPT = """const apiKey = "abcd";
const api_key: "abcd",
// password = "hidden"
 * token
/* secret = "block opener" */ eval (x);
let x = 'a'; el.innerHTML == y; document . write(z); document.write (z)
medieval(x)
db_pass = "abcd"; passwd="abc"; secret = 'abcd' "other"
"""


def test_script_rules(corpus):
    rows = apply_line_rules(corpus({"a.js": SCRIPT, "b.TSX": "eval(x)", "c.txt": "eval(x)", "d.js": "clean()"}))
    got = sorted((r.file_path, r.line_number, r.title) for r in rows.collect())
    assert got == [
        ("a.js", 1, "Hardcoded Secret Detected"),
        ("a.js", 2, "Hardcoded Secret Detected"),
        ("a.js", 5, "Dangerous eval() Usage"),
        ("a.js", 5, "Hardcoded Secret Detected"),
        ("a.js", 6, "Potential XSS via innerHTML"),
        ("a.js", 6, "document.write() Usage"),
        ("a.js", 8, "Hardcoded Secret Detected"),
        ("b.TSX", 1, "Dangerous eval() Usage"),
    ]
    evidence = {r.line_number: r.evidence for r in rows.collect() if "Secret" in r.title}
    assert evidence[8] == "db_pass = \"[REDACTED]\"; passwd=\"[REDACTED]\"; secret = '[REDACTED]' \"other\""


@pytest.mark.parametrize("line,found", [
    ('API_KEY = "abc123secretvalue"', True), ('password = "hunter2demo"', True), ("pw = 'hi'", False), ("password = 'abc'", False),
    ("# passwd = 'abcd'", True), ("db-pass = 'abcd'", True), ("dbpass='abcd'", True), ("password: 'abcd'", False), ("ACCESSTOKEN='abcd'", True),
])
def test_python_secrets(corpus, line, found):
    rows = FD.all_findings(corpus({"a.py": f"# x\n{line}\n"})).collect() if line[0] == "#" else apply_line_rules(corpus({"a.py": f"# x\n{line}\n"})).collect()
    assert [(r.line_number, r.severity) for r in rows] == ([(2, "critical")] if found else [])
    assert all("[REDACTED]" in r.evidence for r in rows)


def test_syntax_errors_hide_secrets(corpus):
    files = corpus({"a.py": 'API_KEY = "abcdef"\ndef f(:\n', "b.py": 'API_KEY = "abcdef"\n'})
    assert sorted((r.file_path, r.title) for r in analyze(files).collect()) == [
        ("a.py", "Syntax Error"), ("b.py", "Hardcoded Secret Detected")]
    both = FD.all_findings(files, scan_unparsed=True).where("title like 'Hard%'")
    assert both.count() == 2


def test_own_rules_as_rows(spark, corpus):
    table = spark.createDataFrame(
        [("py", r"\btoken\s*=\s*\"", "security", "high", "Token", "d", "s", 0.5, False, "")],
        "language string, pattern string, category string, severity string, title string, description string, suggested_fix string, "
        "confidence double, redact boolean, first string")
    rules = rules_from_table(table)
    assert isinstance(rules[0], LineRule)
    rows = apply_line_rules(corpus({"a.py": "x\n token = \"abc\"\n"}), LINE_RULES + rules).collect()
    assert [(r.title, r.line_number, r.evidence) for r in rows] == [("Token", 2, 'token = "abc"')]


def test_dispatch(spark, corpus):
    files = corpus({s: {"a.py": "eval(x)\n", "a.js": "eval(x)\n"} for s in ("python", "javascript", "typescript", "go", "unknown", "none")})
    stacks = spark.createDataFrame([(s, s) for s in ("python", "javascript", "typescript", "go", "unknown")], "repo_id string, tech_stack string")
    early = FD.dispatch(files, stacks).select("repo_id", "path").collect()
    expected = sorted([("python", "a.py"), ("javascript", "a.js"), ("typescript", "a.js")] + [(r, f) for r in ("unknown", "none") for f in ("a.py", "a.js")])
    assert sorted(map(tuple, early)) == expected
    late = FD.all_findings(files, stacks=stacks).select("repo_id", "file_path").collect()
    assert sorted(map(tuple, late)) == expected


def test_dedup_keeps_the_first(spark, corpus):
    rows = FD.dedup_findings(FD.all_findings(corpus({"a.py": "import os, sys\n"}))).collect()
    assert [r.description[:4] for r in rows] == ["'os'"]
    found = spark.createDataFrame(
        [("r", "f", 1, "t", s) for s in (3, 1, 2)] + [("r", "f", 2, "t", 9), ("r", None, 1, "t", 5), ("r", None, 1, "t", 4)],
        "repo_id string, file_path string, line_number int, title string, seq long")
    assert sorted(r.seq for r in FD.dedup_findings(found).collect()) == [1, 4, 9]
    assert "WindowGroupLimit" in FD.dedup_findings(found)._jdf.queryExecution().toString()
    counts = FD.finding_counts(found).first()
    assert (counts.raw, counts.deduplicated) == (6, 3)


def test_order_of_production(corpus):
    files = corpus({"b.py": "import os\neval(x)\ndef f(): pass\n", "a.py": "import os\n", "a.js": "eval(x)\nel.innerHTML = eval(y)\n"})
    rows = FD.all_findings(files).orderBy("seq").select("file_path", "title", "line_number").collect()
    assert [tuple(r) for r in rows] == [
        ("a.py", "Unused Import", 1), ("b.py", "Unused Import", 1), ("b.py", "Dangerous eval() Call", 2),
        ("b.py", "No Test for 'f'", 3),
        ("a.js", "Dangerous eval() Usage", 1), ("a.js", "Dangerous eval() Usage", 2), ("a.js", "Potential XSS via innerHTML", 2),
    ]


SHOP = {
    "shop.py": 'import json\nimport math\n\nPASSWORD = "letmein99"\n\n\ndef price(n):\n    left = n\n    return math.floor(n)\n\n\n'
               "def load(text):\n    try:\n        return eval(text)\n    except Exception:\n        pass\n",
    "cli.py": "import subprocess\n\n\ndef main(cmd):\n    subprocess.call(cmd, shell=True)\n",
    "tests/test_shop.py": "from shop import price\n\n\ndef test_price():\n    assert price(1.5) == 1\n",
    "build/gen.py": "import os\n\n\ndef generated():\n    pass\n",
    "pytest.ini": "[pytest]\n",
}


def test_small_repository(corpus):
    rows = analyze(corpus({"shop": SHOP})).select("file_path", "line_number", "severity", "title").collect()
    assert sorted(map(tuple, rows)) == sorted([
        ("shop.py", 1, "low", "Unused Import"),
        ("shop.py", 4, "critical", "Hardcoded Secret Detected"),
        ("shop.py", 8, "low", "Unused Variable"),
        ("shop.py", 14, "high", "Dangerous eval() Call"),
        ("shop.py", 15, "medium", "Broad Exception Silenced"),
        ("cli.py", 5, "high", "Insecure subprocess shell=True"),
        ("shop.py", 12, "low", "No Test for 'load'"),
        ("cli.py", 4, "low", "No Test for 'main'"),
        # The missing-test rule looks into skipped folders too.
        ("build/gen.py", 4, "low", "No Test for 'generated'"),
    ])
    row = repo_health(corpus({"shop": SHOP, "empty": {"README.md": "x"}})).orderBy("repo_id").collect()
    assert [(r.repo_id, r.findings, r.penalty, r.health_score) for r in row] == [("empty", 0, 0, 100), ("shop", 9, 73, 27)]


@pytest.mark.parametrize("severities,score", [
    (["critical"], 80), ([], 100), (["low"] * 50, 0), (["high", "medium", "low"], 74), (["info"], 100), ([None], 100),
])
def test_scores(spark, severities, score):
    issues = spark.createDataFrame([("r", s) for s in severities], "repo_id string, severity string")
    repos = spark.createDataFrame([("r",)], "repo_id string")
    assert health_score(issues, repos).first().health_score == score


def test_issue_ids_do_not_depend_on_the_run_of_the_job(corpus):
    found = analyze(corpus({"shop": SHOP}))
    ids = lambda run: sorted(r.issue_id for r in FD.to_issues(found, run).select("issue_id").collect())
    assert ids("a") == ids("a") and not set(ids("a")) & set(ids("b"))


def test_facts_as_rows(corpus):
    rows = fact_rows(extract_facts(corpus({"a.py": "import os\ndef f():\n    x = os\n    return x\n", "b.py": "def (\n"})))
    assert sorted((r.path, r.kind, r.name) for r in rows.collect()) == [
        ("a.py", "assign", "x"), ("a.py", "def", "f"), ("a.py", "import", "os"), ("a.py", "load", "x"), ("a.py", "use", "os"),
        ("b.py", "error", "syntax_error")]


def test_sql_access(spark, corpus):
    register(spark)
    corpus({"a.py": "def f(): pass\ndef g(): pass\n", "b.py": "def ("}).createOrReplaceTempView("files")
    rows = spark.sql("SELECT path, name, line FROM files, LATERAL ast_defs(content)").collect()
    assert sorted(map(tuple, rows)) == [("a.py", "f", 1), ("a.py", "g", 2)]
