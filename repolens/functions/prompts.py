"""The text of a fix request, and the fields read back out of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.functions.text import java_pattern, strip


def _or(col: Column, default: str) -> Column:
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit(default)).otherwise(col)


def numbered(steps: Column) -> Column:
    return F.array_join(
        F.transform(steps, lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), s)), "\n"
    )


def build_fix_prompt(
    file_path: Column,
    line_number: Column,
    title: Column,
    description: Column,
    evidence: Column,
    suggested_fix: Column,
    steps: Column,
) -> Column:
    """The request text of one issue; line 0 counts as unknown."""
    # Wording of the request.
    line = F.when(F.coalesce(line_number, F.lit(0)) == 0, F.lit("unknown")).otherwise(line_number.cast("string"))
    head = F.concat(
        F.lit("Fix the following issue in the repository:\n\nFile: "), _or(file_path, "unknown"),
        F.lit("\nLine: "), line,
        F.lit("\nIssue: "), title,
        F.lit("\nDescription: "), description,
        F.lit("\nEvidence: "), _or(evidence, "none"),
        F.lit("\nSuggested fix: "), _or(suggested_fix, "none"),
        F.lit("\n"),
    )
    plan = F.when(F.size(steps) > 0, F.concat(F.lit("\nFix plan:\n"), numbered(steps), F.lit("\n")))
    return F.concat(
        head,
        F.coalesce(plan, F.lit("")),
        F.lit(
            "\nApply the minimal correct fix. Do not modify any other files. "
            "Do not add extra comments or whitespace changes."
        ),
    )


def parse_fix_prompt(prompt: Column) -> Column:
    """``struct(file, issue, line)``; file and line are null if absent, issue is lower case.

    ``(?d)`` keeps ``\\n`` the only line end, as ``U+0085`` may stand inside a title.
    """
    field = lambda name, value: F.regexp_extract(prompt, "(?dm)" + java_pattern(rf"^{name}:\s*({value})"), 1)
    file = field("File", ".+")
    line = field("Line", r"\d+")
    return F.struct(
        F.when(file != "", strip(file)).alias("file"),
        F.lower(strip(field("Issue", ".+"))).alias("issue"),
        F.when(line != "", line.try_cast("int")).alias("line"),
    )
