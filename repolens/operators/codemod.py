"""Rewrites that fix issues, as column expressions over file contents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.functions import text as X
from repolens.session import materialize
from repolens.sources.layout import beside

# Rewrite patterns.
SECRET_LINE = r"^(\s*\w+)\s*=\s*[\"'].+[\"']"
SECRET_NAMES = r"^(\s*(?:API_KEY|DB_PASSWORD|SECRET|PASSWORD|TOKEN)\s*=\s*)[\"'].+[\"']"
SHELL_CALL = r"(subprocess\.\w+\([^)]*),\s*shell\s*=\s*True"
ASSIGNMENT = r"^(\s*)(\w+)(\s*=)"
EVAL_RETURN = "return eval(expr)"
EVAL_FIXED = f"import ast\n    return ast.literal_eval(expr)  {K.FIX_MARK}"
EXCEPT_FIXED = f"except Exception:  {K.FIX_MARK}"


def codemod_kind(title: Column, category: Column) -> Column:
    """Which rewrite an issue asks for, null if none; missing tests go by category, others by title."""
    t = F.lower(title)
    has = lambda word: F.contains(t, F.lit(word))
    return (
        F.when((category == "missing_test") | has("missing test") | has("untested"), F.lit("stub"))
        .when(has("secret"), F.lit("secret"))
        .when(has("eval"), F.lit("eval"))
        .when(has("shell=true") | has("subprocess"), F.lit("shell"))
        .when(has("unused import"), F.lit("import"))
        .when(has("unused variable"), F.lit("variable"))
        .when(has("except"), F.lit("except"))
    )


def _unix(pattern: str) -> str:
    """``(?d)``: only ``\\n`` ends a line, for ``.`` as well."""
    return "(?d)" + X.java_pattern(pattern)


def _secret_name(line: Column) -> Column:
    return F.regexp_extract(line, _unix(SECRET_LINE), 1)


def fix_secret_line(line: Column) -> Column:
    """A quoted value becomes a look-up in the environment; what follows it is dropped."""
    name = _secret_name(line)
    fixed = F.concat(name, F.lit(' = os.environ.get("'), X.strip(name), F.lit(f'", "")  {K.FIX_MARK}\n'))
    return F.when(name != "", fixed).otherwise(line)


def fix_import_line(line: Column) -> Column:
    """A line that starts with ``import`` becomes a comment."""
    fixed = F.concat(F.lit("# "), F.rtrim(line, F.lit(K.BLANKS)), F.lit(f"  {K.FIX_MARK}: removed unused import\n"))
    return F.when(X.strip(line).startswith("import "), fixed).otherwise(line)


def fix_variable_line(line: Column) -> Column:
    """The assigned name gets an underscore in front."""
    name = F.regexp_extract(line, X.java_pattern(ASSIGNMENT), 2)
    fixed = F.regexp_replace(line, X.java_pattern(ASSIGNMENT), "$1_$2$3")
    return F.when((name != "") & ~name.startswith("_"), fixed).otherwise(line)


def fix_named_secrets(text: Column) -> Column:
    """Every quoted value of one of the well-known names."""
    return F.regexp_replace(text, "(?mi)" + _unix(SECRET_NAMES), f'$1os.environ.get("SECRET", "")  {K.FIX_MARK}')


def fix_eval(text: Column) -> Column:
    return X.replace_first(text, EVAL_RETURN, EVAL_FIXED)


def fix_shell(text: Column) -> Column:
    return F.regexp_replace(text, X.java_pattern(SHELL_CALL), "$1, shell=False")


def fix_except(text: Column) -> Column:
    return X.replace_first(text, "except:", EXCEPT_FIXED)


_LINE_FIXES: list[tuple[str, Callable[[Column], Column]]] = [
    ("secret", fix_secret_line), ("import", fix_import_line), ("variable", fix_variable_line),
]
_TEXT_FIXES: list[tuple[str, Callable[[Column], Column]]] = [
    ("eval", fix_eval), ("shell", fix_shell), ("except", fix_except),
]


def issue_targets(issues: DataFrame, files: DataFrame, content: str = "content", laid_out: bool = False) -> DataFrame:
    """``(issue_id, repo_id, file_path, line_number, target)``: issues with the line they point at.

    An issue whose file is missing is left out; ``target`` is null outside the file. Issues of a file
    are gathered as line numbers before they meet its content, so it is not repeated per issue; the
    numbers are written first, so Spark knows their size and broadcasts them if they are few. ``laid_out``
    tells that ``files`` is a table of :mod:`repolens.sources.layout`, whose contents then stay in place.
    """
    wanted = issues.select("repo_id", F.col("file_path").alias("path"), F.coalesce("line_number", F.lit(0)).alias("n")).distinct()
    per_file = materialize(wanted.groupBy("repo_id", "path").agg(F.collect_list("n").alias("ns")), "pointers")
    source = files.select("repo_id", "path", F.col(content).alias("_text"))
    lines = X.split_lines(F.col("_text"))
    found = source.join(beside(per_file, laid_out), ["repo_id", "path"]).withColumn("_lines", lines).select(
        "repo_id", F.col("path").alias("file_path"),
        F.explode(F.transform("ns", lambda n: F.struct(n.alias("n"), F.when(n > 0, F.get("_lines", n - 1)).alias("target")))).alias("t"),
    ).select("repo_id", "file_path", F.col("t.n").alias("_n"), F.col("t.target").alias("target"))
    rows = issues.select("issue_id", "repo_id", "file_path", "line_number", F.coalesce("line_number", F.lit(0)).alias("_n"))
    return rows.join(found, ["repo_id", "file_path", "_n"]).drop("_n")


def file_edits(issues: DataFrame) -> DataFrame:
    """One row per file: the rewrites asked for, and the lines of the line rewrites.

    Equal edits are merged first, so a row holds at most one number per line and rewrite of its file.
    """
    kind = codemod_kind(F.col("title"), F.col("category"))
    edits = issues.select("repo_id", F.col("file_path").alias("path"), kind.alias("kind"), "line_number")
    edits = edits.where(F.col("kind").isin([k for k, _ in _LINE_FIXES + _TEXT_FIXES]))
    line = F.when(F.col("kind").isin([k for k, _ in _LINE_FIXES]), F.coalesce("line_number", F.lit(0)))
    merged = edits.select("repo_id", "path", "kind", line.alias("line")).distinct()
    of = lambda k: F.when(F.col("kind") == k, F.col("line"))
    return merged.groupBy("repo_id", "path").agg(
        *[F.collect_list(of(k)).alias(f"{k}_lines") for k, _ in _LINE_FIXES],
        *[F.bool_or(F.col("kind") == k).alias(f"fix_{k}") for k, _ in _TEXT_FIXES],
    )


def edit_lines(lines: Column, numbers: Column, fix: Callable[[Column], Column]) -> Column:
    """``lines`` with ``fix`` applied to those of the given numbers, from 1; others outside are ignored.

    The runs between edits are cut out in order, so the time is linear in the lines however many edits
    there are.
    """
    inside = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= F.size(lines)))))
    both = F.struct(lines.alias("lines"), F.concat(F.array(F.lit(0)), inside, F.array(F.size(lines) + 1)).alias("at"))

    def run(x: Column, i: Column) -> Column:
        start, end = F.get(x["at"], i - 1), F.get(x["at"], i)
        rest = F.slice(x["lines"], start + 1, end - start - 1)
        return F.when(start == 0, rest).otherwise(F.concat(F.array(fix(F.get(x["lines"], start - 1))), rest))

    return X.let(both, lambda x: F.flatten(F.transform(F.sequence(F.lit(1), F.size(x["at"]) - 1), lambda i: run(x, i))))


def rewrite(rows: DataFrame) -> DataFrame:
    """Adds ``after``: ``before`` with the edits of a row of :func:`file_edits` applied.

    Line rewrites come first and keep the number of lines, so their line numbers stay valid; then
    the well-known secret names where a secret's line has no assignment, then whole-text rewrites.
    Each step is a column of its own, as it uses the one before it several times.
    """
    wanted = {kind: F.size(f"{kind}_lines") > 0 for kind, _ in _LINE_FIXES}
    any_line = reduce(or_, wanted.values())
    rows = rows.withColumn("_lines", F.when(any_line, X.split_lines_keep_ends(F.col("before"))))
    named = F.exists("secret_lines", lambda n: _secret_name(F.coalesce(F.get("_lines", n - 1), F.lit(""))) == "")
    rows = rows.withColumn("_named", named)
    for kind, fix in _LINE_FIXES:
        edited = edit_lines(F.col("_lines"), F.col(f"{kind}_lines"), fix)
        rows = rows.withColumn("_lines", F.when(wanted[kind], edited).otherwise(F.col("_lines")))
    after = F.col("after")
    rows = rows.withColumn("after", F.when(any_line, F.array_join("_lines", "")).otherwise(F.col("before")))
    rows = rows.withColumn("after", F.when(F.col("_named"), fix_named_secrets(after)).otherwise(after))
    for kind, fix in _TEXT_FIXES:
        rows = rows.withColumn("after", F.when(F.col(f"fix_{kind}"), fix(after)).otherwise(after))
    return rows


def apply_codemods(issues: DataFrame, files: DataFrame, content: str = "content", laid_out: bool = False) -> DataFrame:
    """``(repo_id, path, before, after, applied)`` of every file some issue asks to rewrite.

    All issues of a file are applied together; ``applied`` tells if the text changed. Edits are one
    narrow row per file and are written first, so Spark knows their size: below its broadcast
    threshold contents are not shuffled. ``laid_out`` tells that ``files`` is a table of
    :mod:`repolens.sources.layout`: then they never are.
    """
    edits = beside(materialize(file_edits(issues), "edits"), laid_out)
    rows = files.select("repo_id", "path", F.col(content).alias("before")).join(edits, ["repo_id", "path"])
    return rewrite(rows).select(
        "repo_id", "path", "before", "after", (F.col("before") != F.col("after")).alias("applied")
    )


def stub_tests(issues: DataFrame) -> DataFrame:
    """``(repo_id, path, after)``: a new test file per source file with untested functions.

    Functions come in order of name; a name is there once, so the file stays below its source's size.
    """
    kind = codemod_kind(F.col("title"), F.col("category"))
    name = F.regexp_extract("title", r"'(\w+)'", 1)
    named = issues.where(kind == "stub").select(
        "repo_id", "file_path", F.when(name == "", F.lit("function")).otherwise(name).alias("name")
    ).distinct()
    stub = lambda n: F.concat(
        F.lit("def test_"), n, F.lit('_stub():\n    """Stub test for '), n,
        F.lit(' \u2014 fill in real assertions."""\n    pass\n'),
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list("name")), stub), "\n\n")
    path = F.concat(F.lit("tests/test_"), F.replace("file_path", F.lit("/"), F.lit("_")), F.lit("_stubs.py"))
    return named.groupBy("repo_id", "file_path").agg(body.alias("body")).select(
        "repo_id", path.alias("path"), F.concat(F.lit(f"{K.FIX_MARK}: generated stub tests\n"), F.col("body")).alias("after")
    )
