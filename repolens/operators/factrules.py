"""Rules over the facts of Python files.

All but one are file-local and work on the arrays of a row. Untested functions need the test names
of the whole repository and are one anti join, cut by key size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.functions import paths as P


def _parsed(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("error").isNull())


def _findings(rows: DataFrame, stage: int, check: int, fixed: dict, *, line: Column, pos: Column, sub: Column | None = None,
              **columns: Column) -> DataFrame:
    """Finding columns from rows with ``repo_id`` and ``path``; ``fixed`` holds the constant ones."""
    value = lambda name: columns[name] if name in columns else F.lit(fixed[name])
    return rows.select(
        "repo_id",
        F.col("path").alias("file_path"),
        line.cast("int").alias("line_number"),
        *[value(n).alias(n) for n in ("category", "severity", "title", "description", "evidence", "suggested_fix", "confidence")],
        F.struct(
            F.lit(stage).alias("stage"),
            F.col("path").alias("path"),
            F.lit(check).cast("bigint").alias("a"),
            pos.cast("bigint").alias("b"),
            (sub if sub is not None else F.lit(0)).cast("bigint").alias("c"),
        ).alias("seq"),
    )


def _say(*pieces: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def syntax_errors(facts: DataFrame) -> DataFrame:
    """Files that do not parse; no other file-local rule looks at them."""
    bad = facts.where(F.col("error.kind") == "syntax_error")
    return _findings(
        bad, 1, 0, K.SYNTAX_ERROR, line=F.col("error.line"), pos=F.lit(0),
        description=_say("Python syntax error: ", F.col("error.message")), evidence=F.col("error.text"),
    )


def unparsed_files(facts: DataFrame) -> DataFrame:
    """Files the parser gave up on. They may be valid, so their line findings stay."""
    bad = facts.where(F.col("error.kind") == "parse_error")
    return _findings(
        bad, 1, 0, K.UNPARSED_FILE, line=F.col("error.line"), pos=F.lit(0),
        description=_say("The parser gave up on this file: ", F.col("error.message")), evidence=F.col("error.text"),
    )


def unused_imports(facts: DataFrame) -> DataFrame:
    """Imported names no expression of the module mentions."""
    unused = F.filter("imports", lambda b: ~F.array_contains(F.col("used"), b["name"]) & P.is_public(b["name"]))
    rows = _parsed(facts).select("repo_id", "path", F.explode(unused).alias("b"))
    name = F.col("b.name")
    return _findings(
        rows, 1, 1, K.UNUSED_IMPORT, line=F.col("b.line"), pos=F.col("b.pos"), evidence=F.col("b.text"),
        description=_say("'", name, "' is imported but never used in this module."),
        suggested_fix=_say("Remove the import of '", name, "' or use it."),
    )


def broad_except(facts: DataFrame) -> DataFrame:
    """Bare, ``Exception`` or ``BaseException`` handlers with nothing but ``pass``."""
    silent = F.filter(
        "handlers",
        lambda h: h.only_pass & (h["type"].isNull() | F.coalesce(h["type"].isin("Exception", "BaseException"), F.lit(False))),
    )
    rows = _parsed(facts).select("repo_id", "path", F.posexplode(silent).alias("n", "h"))
    return _findings(rows, 1, 2, K.BROAD_EXCEPT, line=F.col("h.line"), pos=F.col("h.idx"), sub=F.col("n"),
                     evidence=F.col("h.text"))


def eval_exec_calls(facts: DataFrame) -> DataFrame:
    """Calls named ``eval`` or ``exec`` whose first argument is not a constant."""
    risky = F.filter("calls", lambda c: c["name"].isin(K.EVAL_NAMES) & ~c.constant_arg)
    rows = _parsed(facts).select("repo_id", "path", F.explode(risky).alias("c"))
    name = F.col("c.name")
    return _findings(
        rows, 1, 3, K.EVAL_CALL, line=F.col("c.line"), pos=F.col("c.idx"), evidence=F.col("c.text"),
        title=_say("Dangerous ", name, "() Call"),
        description=_say(
            "`", name, "()` executes arbitrary code. If the argument comes from user "
            "input this is a Remote Code Execution vulnerability."
        ),
        suggested_fix=_say("Replace `", name, "()` with a safe alternative (e.g. ast.literal_eval for data)."),
    )


def shell_true_calls(facts: DataFrame) -> DataFrame:
    """Calls named like a subprocess function with a literal ``shell=True``."""
    shell = F.filter("calls", lambda c: c["name"].isin(K.SUBPROCESS_NAMES) & c.shell_true)
    rows = _parsed(facts).select("repo_id", "path", F.explode(shell).alias("c"))
    return _findings(
        rows, 1, 4, K.SHELL_TRUE, line=F.col("c.line"), pos=F.col("c.idx"), evidence=F.col("c.text"),
        description=_say(
            "`subprocess.", F.col("c.name"), "(..., shell=True)` enables shell injection. "
            "Attackers can inject arbitrary shell commands if the command includes user input."
        ),
    )


def unused_variables(facts: DataFrame) -> DataFrame:
    """Plain names assigned in a function and never read in it or in what is nested in it."""
    scopes = _parsed(facts).select("repo_id", "path", F.explode("scopes").alias("s"))
    unused = F.filter("s.assigned", lambda b: ~F.array_contains(F.col("s.loaded"), b["name"]) & P.is_public(b["name"]))
    rows = scopes.select("repo_id", "path", F.col("s.scope").alias("scope"), F.explode(unused).alias("b"))
    name = F.col("b.name")
    return _findings(
        rows, 1, 5, K.UNUSED_VARIABLE, line=F.col("b.line"), pos=F.col("scope"), sub=F.col("b.pos"),
        evidence=F.col("b.text"),
        description=_say("Variable '", name, "' is assigned but never used."),
        suggested_fix=_say("Remove the assignment or use '", name, "'."),
    )


def untested_functions(facts: DataFrame, skip_vendored: bool = False) -> DataFrame:
    """Public functions outside test files that no test is named after.

    A function ``f`` is covered by a test function ``f``, ``test_f`` or ``test_test_f``; these are
    the only names from which ``f`` or ``test_f`` can come by taking one ``test_`` off. So the test
    names are expanded once and one anti join is enough. Vendored folders count as code unless
    ``skip_vendored``.
    """
    good = _parsed(facts).where(F.col("path").endswith(".py"))
    if skip_vendored:
        good = good.where(P.keep_for_analysis(F.col("path")))
    defs = good.select("repo_id", "path", P.is_test_file(F.col("path")).alias("is_test"), F.explode("defs").alias("d"))
    name = F.col("d.name")
    public = defs.where(~F.col("is_test") & P.is_public(name)).select(
        "repo_id", "path", name.alias("name"), F.col("d.line").alias("line"), F.col("d.idx").alias("idx")
    )
    spellings = F.array(
        name,
        F.regexp_extract(name, "^test_(.*)$", 1),
        F.regexp_extract(name, "^test_test_(.*)$", 1),
    )
    tested = (
        defs.where("is_test").select("repo_id", F.explode(spellings).alias("name"))
        .where(F.col("name") != "").distinct()
    )
    rows = public.join(tested, ["repo_id", "name"], "left_anti")
    name = F.col("name")
    return _findings(
        rows, 2, 0, K.MISSING_TEST, line=F.col("line"), pos=F.col("idx"),
        title=_say("No Test for '", name, "'"),
        description=_say("Function '", name, "' in ", F.col("path"), " has no corresponding test."),
        evidence=_say("def ", name, "(...)"),
        suggested_fix=_say("Add a test function named 'test_", name, "' in the tests/ directory."),
    )


FILE_RULES = [syntax_errors, unparsed_files, unused_imports, broad_except, eval_exec_calls, shell_true_calls, unused_variables]
