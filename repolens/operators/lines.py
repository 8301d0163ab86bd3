"""Lines of source files, and rules that are patterns over lines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.functions import paths as P
from repolens.functions import text as X


@dataclass(frozen=True)
class LineRule:
    """A pattern over single lines; ``language`` is ``py`` or ``js``.

    ``first`` may list the characters a match can start with: other places are passed over without
    trying the pattern.
    """

    language: str
    pattern: str
    category: str
    severity: str
    title: str
    description: str
    suggested_fix: str
    confidence: float
    redact: bool = False
    first: str = ""

    @property
    def java(self) -> str:
        guard = f"(?=[{self.first}])" if self.first else ""
        return guard + X.java_pattern(self.pattern)


# The line rules, in the order in which their findings are produced.
LINE_RULES = [
    LineRule(
        "py", K.PY_SECRET_PATTERN, "security", "critical", "Hardcoded Secret Detected",
        "A password, API key, or secret token appears to be hardcoded in source code. "
        "This exposes credentials to anyone with repository access.",
        "Move secrets to environment variables or a secrets manager.", 0.88, redact=True, first="pPsS\u017faAcCdD",
    ),
    LineRule(
        "js", K.JS_SECRET_PATTERN, "security", "critical", "Hardcoded Secret Detected",
        "A secret/credential appears to be hardcoded in source.",
        "Move to environment variables (process.env.SECRET).", 0.85, redact=True, first="pPsS\u017faAcC",
    ),
    LineRule(
        "js", K.JS_EVAL_PATTERN, "security", "high", "Dangerous eval() Usage",
        "`eval()` executes arbitrary JS and is a security risk.",
        "Remove eval(); use JSON.parse() or a safe alternative.", 0.9,
    ),
    LineRule(
        "js", K.JS_DOCUMENT_WRITE_PATTERN, "security", "medium", "document.write() Usage",
        "`document.write()` can enable XSS and is considered bad practice.",
        "Use DOM manipulation methods instead.", 0.8,
    ),
    LineRule(
        "js", K.JS_INNER_HTML_PATTERN, "security", "medium", "Potential XSS via innerHTML",
        "Assigning to `.innerHTML` with unsanitized data enables XSS attacks.",
        "Use textContent or sanitize the input with DOMPurify.", 0.75,
    ),
]


def rules_from_table(rules: DataFrame) -> list[LineRule]:
    """Rules kept as rows with the fields of :class:`LineRule`. Rules are code: each becomes a part of one
    projection, so the driver needs them all."""
    return [LineRule(**r.asDict()) for r in rules.collect()]


def source_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """``lines(repo_id, path, line_number, line)``."""
    return files.select(
        "repo_id", "path", F.posexplode(X.split_lines(F.col(content))).alias("at", "line")
    ).select("repo_id", "path", (F.col("at") + 1).alias("line_number"), "line")


def _hit(rule: LineRule, number: int, line: Column) -> Column:
    matched = (F.col("language") == rule.language) & line.rlike(rule.java)
    evidence = X.strip(line)
    if rule.redact:
        evidence = X.redact_py(evidence) if rule.language == "py" else X.redact_js(evidence)
    fields = F.struct(
        F.lit(number).alias("rule"),
        F.lit(rule.category).alias("category"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.title).alias("title"),
        F.lit(rule.description).alias("description"),
        evidence.alias("evidence"),
        F.lit(rule.suggested_fix).alias("suggested_fix"),
        F.lit(rule.confidence).alias("confidence"),
    )
    return F.when(matched, fields)


def rule_language(path: Column) -> Column:
    """``py``, ``js`` or null, by suffix."""
    return F.when(P.has_ext(path, K.PYTHON_SUFFIXES), F.lit("py")).when(
        P.has_ext(path, K.SCRIPT_SUFFIXES), F.lit("js")
    )


def line_hits(rules: list[LineRule] = LINE_RULES, content: str = "content") -> Column:
    """``array<struct<line_number, h>>``: what the rules of ``language`` find in a content; null if none of
    them matches anywhere in it, which is known before it is cut into lines."""
    text, language = F.col(content), F.col("language")
    candidate = reduce(or_, [(language == r.language) & text.rlike(r.java) for r in rules])
    lines = F.transform(X.split_lines(text), lambda line, at: F.struct((at + 1).alias("line_number"), line.alias("line")))
    code = F.filter(lines, lambda x: (language == "py") | X.is_js_code(x["line"]))

    def of_line(x: Column) -> Column:
        hits = F.filter(F.array(*[_hit(r, n, x["line"]) for n, r in enumerate(rules, 1)]), lambda h: h.isNotNull())
        return F.transform(hits, lambda h: F.struct(x["line_number"].alias("line_number"), h.alias("h")))

    return F.when(candidate, F.flatten(F.transform(code, of_line)))


def hit_findings(rows: DataFrame) -> DataFrame:
    """Findings from rows with ``repo_id``, ``path`` and the ``hits`` of :func:`line_hits`."""
    found = rows.select("repo_id", "path", rule_language(F.col("path")).alias("language"), F.inline("hits"))
    is_py, number, rule = F.col("language") == "py", F.col("line_number"), F.col("h.rule")
    seq = F.struct(
        F.when(is_py, 1).otherwise(3).alias("stage"),
        F.col("path").alias("path"),
        F.when(is_py, 6).otherwise(number).cast("bigint").alias("a"),
        F.when(is_py, number).otherwise(rule).cast("bigint").alias("b"),
        rule.cast("bigint").alias("c"),
    )
    return found.select(
        "repo_id", F.col("path").alias("file_path"), number.cast("int").alias("line_number"),
        "h.category", "h.severity", "h.title", "h.description", "h.evidence", "h.suggested_fix", "h.confidence",
        seq.alias("seq"),
    )


def apply_line_rules(files: DataFrame, rules: list[LineRule] = LINE_RULES, content: str = "content") -> DataFrame:
    """Findings of the rules over ``files(repo_id, path, <content>)``, each for its own language.

    The rules become one projection, so there is one scan and no join of lines and rules.
    """
    named = files.withColumn("language", rule_language(F.col("path")))
    return hit_findings(named.select("repo_id", "path", line_hits(rules, content).alias("hits")))
