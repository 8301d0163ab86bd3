"""Rewrites against plain Python, and diffs."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from repolens.operators import codemod as C
from repolens.operators import diffs as D

SOURCE = '''import os
import sys, json
from a import b
API_KEY = "abc"  # noqa
  token = 'x "y" z'
def f():
    tmp = 1
    _u = 2
    return eval(expr)
def g():
    return eval(expr)
try:
    subprocess.run(cmd, shell=True, text=True)
    subprocess.call([
        "a"], shell = True)
except:
    pass
try: pass
except: pass
password = "last"'''


def one(spark, source, *issues):
    files = spark.createDataFrame([("r", "a.py", source), ("r", "other.py", source)], "repo_id string, path string, content string")
    rows = [("r", "a.py", line, title, category) for line, title, category in issues]
    issues = spark.createDataFrame(rows, "repo_id string, file_path string, line_number int, title string, category string")
    return C.apply_codemods(issues, files).collect()


def edited(changes, source=SOURCE):
    lines = source.splitlines(keepends=True)
    for n, text in changes.items():
        lines[n - 1] = text
    return "".join(lines)


SECRET = "Hardcoded Secret Detected"
CASES = [
    ((4, SECRET, "security"), edited({4: 'API_KEY = os.environ.get("API_KEY", "")  # autofix\n'})),
    ((5, SECRET, "security"), edited({5: '  token = os.environ.get("token", "")  # autofix\n'})),
    ((20, SECRET, "security"), edited({20: 'password = os.environ.get("password", "")  # autofix\n'})),
    # No assignment on the line: all well-known names, in any case, with blanks before them.
    ((1, SECRET, "security"), edited({4: 'API_KEY = os.environ.get("SECRET", "")  # autofix  # noqa\n',
                                      5: '  token = os.environ.get("SECRET", "")  # autofix\n',
                                      20: 'password = os.environ.get("SECRET", "")  # autofix'})),
    ((None, SECRET, "security"), edited({4: 'API_KEY = os.environ.get("SECRET", "")  # autofix  # noqa\n',
                                         5: '  token = os.environ.get("SECRET", "")  # autofix\n',
                                         20: 'password = os.environ.get("SECRET", "")  # autofix'})),
    ((99, SECRET, "security"), edited({4: 'API_KEY = os.environ.get("SECRET", "")  # autofix  # noqa\n',
                                       5: '  token = os.environ.get("SECRET", "")  # autofix\n',
                                       20: 'password = os.environ.get("SECRET", "")  # autofix'})),
    ((9, "Dangerous eval() Call", "security"), edited({9: "    import ast\n    return ast.literal_eval(expr)  # autofix\n"})),
    ((13, "Insecure subprocess shell=True", "security"),
     re.sub(r"(subprocess\.\w+\([^)]*),\s*shell\s*=\s*True", r"\1, shell=False", SOURCE)),
    ((1, "Unused Import", "code_quality"), edited({1: "# import os  # autofix: removed unused import\n"})),
    ((2, "Unused Import", "code_quality"), edited({2: "# import sys, json  # autofix: removed unused import\n"})),
    ((3, "Unused Import", "code_quality"), SOURCE),
    ((7, "Unused Variable", "code_quality"), edited({7: "    _tmp = 1\n"})),
    ((8, "Unused Variable", "code_quality"), SOURCE),
    ((None, "Unused Variable", "code_quality"), SOURCE),
    ((16, "Broad Exception Silenced", "bug"), SOURCE.replace("except:", "except Exception:  # autofix", 1)),
]


@pytest.mark.parametrize("issue,after", CASES, ids=[f"{c[0][1]}-{c[0][0]}" for c in CASES])
def test_one_issue(spark, issue, after):
    (row,) = one(spark, SOURCE, issue)
    assert row.path == "a.py" and row.before == SOURCE
    assert row.after == after
    assert row.applied == (after != SOURCE)


def test_all_issues_of_a_file_together(spark):
    (row,) = one(spark, SOURCE, (4, SECRET, "security"), (1, "Unused Import", "code_quality"), (7, "Unused Variable", "code_quality"),
                 (1, "Unused Import", "code_quality"), (9, "Dangerous eval() Call", "security"),
                 (13, "Insecure subprocess shell=True", "security"), (16, "Broad Exception Silenced", "bug"),
                 (6, "No Test for 'f'", "missing_test"), (3, "Something else", "bug"))
    lines = edited({4: 'API_KEY = os.environ.get("API_KEY", "")  # autofix\n', 1: "# import os  # autofix: removed unused import\n",
                    7: "    _tmp = 1\n"})
    text = lines.replace("return eval(expr)", "import ast\n    return ast.literal_eval(expr)  # autofix", 1)
    text = re.sub(r"(subprocess\.\w+\([^)]*),\s*shell\s*=\s*True", r"\1, shell=False", text)
    assert row.after == text.replace("except:", "except Exception:  # autofix", 1)


def test_issues_without_rewrite_or_file_give_nothing(spark):
    assert one(spark, SOURCE, (6, "No Test for 'eval_it'", "missing_test"), (1, "Syntax Error", "bug")) == []


def test_stub_tests(spark):
    rows = [("r", "a/b.py", "No Test for 'g'", "missing_test"), ("r", "a/b.py", "No Test for 'f'", "missing_test"),
            ("r", "a/b.py", "No Test for 'f'", "missing_test"), ("r", "c.py", "Unused Import", "code_quality")]
    issues = spark.createDataFrame(rows, "repo_id string, file_path string, title string, category string")
    (row,) = C.stub_tests(issues).collect()
    assert row.path == "tests/test_a_b.py_stubs.py"
    names = re.findall(r"^def (\w+)\(\):$", row.after, re.M)
    assert names == ["test_f_stub", "test_g_stub"]
    compile(row.after, row.path, "exec")


def test_diff(spark):
    after = SOURCE.replace("except:", "except OSError:")
    rows = [("r", "a.py", SOURCE, after), ("r", "same", "x", "x"), ("r", "new", None, "1\n2"), ("r", "old", "1", None)]
    diffs = D.unified_diff(spark.createDataFrame(rows, "repo_id string, path string, before string, after string"))
    texts = {r.path: r["diff"] for r in diffs.collect()}
    assert set(texts) == {"a.py", "new", "old"}
    expected = difflib.unified_diff(SOURCE.split("\n"), after.split("\n"), "a/a.py", "b/a.py", lineterm="")
    assert texts["a.py"] == "\n".join(expected)
    assert texts["new"].startswith("--- /dev/null\n+++ b/new\n")
    assert {r.path: (r.added, r.removed) for r in D.diff_stat(diffs).collect()} == {"a.py": (2, 2), "new": (2, 0), "old": (0, 1)}


def test_snapshots(corpus):
    before = corpus({"a": "1", "b": "2", "c": "3"})
    after = corpus({"a": "1", "b": "x", "d": "4"})
    assert {r.path: r.change for r in D.changed_files(before, after).collect()} == {"b": "modified", "c": "removed", "d": "added"}
    assert {r.path for r in D.snapshot_diff(before, after).collect()} == {"b", "c", "d"}


@pytest.mark.parametrize("numbers", [[], [1], [3], [1, 2, 3], [2, 2, 0, 9, -1], [3, 1]])
def test_edits_at_lines(spark, numbers):
    row = spark.createDataFrame([(["a", "b", "c"], numbers)], "lines array<string>, n array<int>")
    got = row.select(C.edit_lines(F.col("lines"), F.col("n"), F.upper)).first()[0]
    assert got == [x.upper() if i in numbers else x for i, x in enumerate("abc", 1)]
