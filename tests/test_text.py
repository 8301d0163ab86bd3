"""Text columns against Python's own str and re."""

import random
import re

import pytest
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.functions import jsontext as J
from repolens.functions import labels as L
from repolens.functions import logs
from repolens.functions import names as N
from repolens.functions import paths as P
from repolens.functions import prompts as PR
from repolens.functions import text as X
from repolens.operators.lines import LINE_RULES

ODD = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u2028", "\u2029", "\xa0", " ", "\t", "\u3000"]
WORDS = ["a", "x = 1", "\u00e9", "//", "*", "'", '"', "password", "API_KEY", "pa\u017f\u017fword", "api-\u212aey", "=", ":", '"hunter2"', "'abcd'",
         "db_pass", "eval", "(", "document.write", ".innerHTML", "import os", "secret", "_"]


def texts(n=3000):
    rng = random.Random(7)
    made = ["".join(rng.choice(rng.choice([ODD, WORDS, WORDS])) for _ in range(rng.randint(0, 9))) for _ in range(n)]
    return sorted(set(made) | {"", "\n", "a\n", "\n\n"})


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(t,) for t in texts()], "t string").cache()


def each(frame, column):
    return {r.t: r.v for r in frame.select("t", column.alias("v")).collect()}


def test_lines_are_those_of_splitlines(frame):
    for t, v in each(frame, X.split_lines(F.col("t"))).items():
        assert v == t.splitlines(), repr(t)


def test_lines_with_ends_give_the_text_back(frame):
    normal = X.decode_source(F.col("t").cast("binary"))
    for t, v in each(frame, X.split_lines_keep_ends(normal)).items():
        text = re.sub("\r\n?", "\n", t)
        assert "".join(v) == text
        assert [x for x in v if x] == text.splitlines(keepends=True)


def test_strip_takes_all_blanks(frame):
    for t, v in each(frame, X.strip(F.col("t"))).items():
        assert v == t.strip(), repr(t)


def test_blanks_are_all_there():
    assert sorted(K.BLANKS) == [chr(i) for i in range(0x110000) if chr(i).isspace()]


@pytest.mark.parametrize("rule", LINE_RULES, ids=lambda r: f"{r.language}-{r.title}")
def test_rules_match_as_in_python(frame, rule):
    pattern = re.compile(rule.pattern)
    hits = 0
    for t, v in each(frame, F.col("t").rlike(rule.java)).items():
        assert v == bool(pattern.search(t)), repr(t)
        hits += v
    assert hits > 0


def test_redaction_matches_python(frame):
    for column, pattern in ((X.redact_py, K.PY_REDACT_PATTERN), (X.redact_js, K.JS_REDACT_PATTERN)):
        for t, v in each(frame, column(F.col("t"))).items():
            assert v == re.sub(pattern, r"\1[REDACTED]\2", t), repr(t)


def test_js_code(frame):
    for t, v in each(frame, X.is_js_code(F.col("t"))).items():
        s = t.strip()
        assert v == bool(s and not s.startswith("//") and not s.startswith("*")), repr(t)


def test_evidence_outside_the_file_is_empty(spark):
    lines = F.array(F.lit(" a "), F.lit("b"))
    row = spark.range(1).select(*[X.evidence_line(lines, F.lit(n)).alias(f"n{n + 1}") for n in (-1, 0, 1, 2, 3)]).first()
    assert list(row) == ["", "", "a", "b", ""]


def test_invalid_utf8_is_replaced(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\r\nc\rd"),), (bytearray(b"\xef\xbb\xbfx"),)], "c binary")
    assert [r[0] for r in df.select(X.decode_source(F.col("c"))).collect()] == ["a\ufffdb\nc\nd", "\ufeffx"]


def test_suffix_and_language(spark):
    from pathlib import PurePosixPath

    paths = ["a.py", ".env", "foo.", "a.min.js", "d/.x.y", "B.TSX", "noext", "a.b/c", "dir.py/x", "x.tar.gz"]
    df = spark.createDataFrame([(p,) for p in paths], "t string")
    for t, v in each(df, P.suffix(F.col("t"))).items():
        expected = PurePosixPath(t).suffix
        assert v == ("" if expected == "." else expected), t
    assert each(df, P.language(F.col("t")))["B.TSX"] == "TypeScript"
    assert each(df, P.exact_language(F.col("t")))["B.TSX"] is None


def test_path_filters(spark):
    paths = ["env", "src/build", "a/.git/x", "src/a.py", "a/vendor/b.py", "logo.PNG", "app.min.js", "1/2/3/4/5/f", "1/2/3/4/5/6/f",
             "tests/conftest.py", "a/tests/x.py", "my_test_x.py"]
    df = spark.createDataFrame([(p,) for p in paths], "t string")
    t = F.col("t")
    assert [p for p in paths if each(df, P.keep_for_analysis(t))[p]] == paths[3:]
    kept = each(df, P.keep_for_profile(t))
    assert [p for p in paths if kept[p]] == ["src/a.py", "app.min.js"] + paths[7:]
    assert not each(df, P.depth_ok(t))["1/2/3/4/5/6/f"]
    tests = each(df, P.is_test_file(t))
    assert [p for p in paths if tests[p]] == ["a/tests/x.py", "my_test_x.py"]


@pytest.mark.parametrize("url,expected", [
    ("https://github.com/owner/repo", ("https://github.com/owner/repo.git", None)),
    ("  https://github.com/owner/repo/ ", ("https://github.com/owner/repo.git", None)),
    ("http://github.com/o.w/r-e_p.git", ("http://github.com/o.w/r-e_p.git", None)),
    ("", (None, "empty")),
    (" // ", (None, "empty")),
    ("https://gitlab.com/a/b", (None, "invalid")),
    ("https://github.com/owner", (None, "invalid")),
    ("https://github.com/a/b/c", (None, "invalid")),
    ("ftp://github.com/a/b", (None, "invalid")),
])
def test_repo_urls(spark, url, expected):
    row = spark.createDataFrame([(url,)], "t string").select(N.normalize_repo_url(F.col("t")).alias("u")).first()
    assert tuple(row.u) == expected


def test_display_names(spark):
    urls = ["https://github.com/a/digit.git", "https://github.com/owner/repo.git", "https://github.com/o/x.gitter.git"]
    df = spark.createDataFrame([(u,) for u in urls], "t string")
    plain = each(df, N.repo_display_name(F.col("t")))
    for u in urls:
        assert plain[u] == "/".join(u.rstrip(".git").rstrip("/").split("/")[-2:])
    assert each(df, N.repo_display_name(F.col("t"), exact_suffix=True))[urls[0]] == "a/digit"
    assert each(df, N.display_url(F.col("t")))[urls[2]] == urls[2].replace(".git", "", 1)


@pytest.mark.parametrize("log,expected", [
    ("5 passed, 2 failed, 1 error in 0.42s", (8, 5, 3)),
    ("7 passed in 0.55s", (7, 7, 0)),
    ("", (0, 0, 0)),
    ("no tests ran in 0.01s", (0, 0, 0)),
    ("4 passed, 1 failed, 1 error in 1.0s", (6, 4, 2)),
    ("3 errors, 2 skipped", (3, 0, 3)),
])
def test_logs(spark, log, expected):
    row = spark.createDataFrame([(log,)], "t string").select(logs.parse_test_log(F.col("t")).alias("l")).first()
    assert tuple(row.l) == expected


def test_last_json(spark):
    cases = {
        'x {"a": 1} y': '{"a": 1}', "none": "{}", "} {": "{}", '{"a": {"b": 1}}': "{}", '{bad} {"k": "v"}': '{"k": "v"}', "{": "{}",
        '{"a": 1} x }': "{}",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert each(df, J.extract_last_json(F.col("t"))) == cases
    assert each(df, J.extract_last_json(F.col("t"), balanced=True))['{"a": {"b": 1}}'] == '{"a": {"b": 1}}'


def test_strict_json(spark):
    cases = {'{"a":1}': True, '"x"': True, "5": True, "1,2": False, '1,"x":2': False, "1],[2": False, "": False, "line": False,
             '{"a":1} rest': False, "[1]": True, "nul": False}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {t: v is not None and v for t, v in each(df, J.parse_json(F.col("t")).isNotNull()).items()} == cases


def test_root_cause(spark):
    df = spark.createDataFrame([('{"root_cause":"c"}',), ("plain",), ("",), ('{"x":1}',)], "t string")
    assert each(df, J.safe_root_cause(F.col("t"))) == {
        '{"root_cause":"c"}': '{"root_cause":"c"}', "plain": '{"root_cause":"plain"}', "": None, '{"x":1}': '{"x":1}'}
    assert each(df, J.root_cause_text(F.col("t"))) == {'{"root_cause":"c"}': "c", "plain": "plain", "": "", '{"x":1}': ""}


def test_sizes_and_labels(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.3 KB", 1536: "1.5 KB", 1048576: "1.0 MB", 5 * 1024**3: "5120.0 MB"}
    df = spark.createDataFrame([(s,) for s in sizes], "t long")
    assert each(df, L.format_bytes(F.col("t"))) == sizes
    df = spark.createDataFrame([(3,), (0,), (-2,), (None,)], "t int")
    assert each(df, L.improvement_label(F.col("t"))) == {3: "+3 pts", 0: "No change", -2: "-2 pts", None: None}
    df = spark.createDataFrame([(80,), (79,), (60,), (59,), (None,)], "t int")
    assert each(df, L.score_band(F.col("t"))) == {80: "green", 79: "yellow", 60: "yellow", 59: "red", None: "none"}


def test_prompt_round_trip(spark):
    df = spark.createDataFrame(
        [("src/a.py", 7, "Title\x85 X", "d", "", None), (None, 0, "T", "d", "e", "f")],
        "file string, line int, title string, description string, evidence string, fix string",
    )
    steps = F.when(F.col("line") > 0, F.array(F.lit("one"), F.lit("two")))
    prompt = PR.build_fix_prompt(*[F.col(c) for c in df.columns], F.coalesce(steps, F.array().cast("array<string>")))
    first, second = df.select(prompt.alias("p"), PR.parse_fix_prompt(prompt).alias("f")).collect()
    assert "\nFix plan:\n  1. one\n  2. two\n\nApply" in first.p and "Fix plan" not in second.p
    assert "Evidence: none\nSuggested fix: none\n" in first.p
    assert tuple(first.f) == ("src/a.py", "title\x85 x", 7)
    assert tuple(second.f) == ("unknown", "t", None)


