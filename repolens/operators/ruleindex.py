"""Many line rules at once, by an index from texts that their matches must hold to the rules.

A rule says more by its pattern than a text, but most patterns cannot match without one: ``\\beval\\s*\\(`` not without
``eval``. One pass over a content finds all such texts in it; only the rules of texts that are there are tried, and
a content without any is never cut into lines. So time follows what is found, not the number of rules.
"""

from __future__ import annotations

import json
import re
import warnings
from collections import Counter
from collections.abc import Iterator
from re import _constants as _op
from re import _parser

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens.functions import text as X
from repolens.operators.lines import LineRule, hit_findings, rule_language

_REPEATS = {_op.MAX_REPEAT, _op.MIN_REPEAT, _op.POSSESSIVE_REPEAT}
#: Characters that match an ASCII letter when case does not count, beside its two forms.
_FOLD = {0x17F: "s", 0x212A: "k", 0x130: "i", 0x131: "i"}
_RULE_ROW = (
    "_rule int, category string, severity string, title string, description string, suggested_fix string, confidence double"
)


def fold(text: str) -> str:
    """Texts that a pattern may take for each other without regard to case fold to one."""
    return text.translate(_FOLD).lower()


def _required(items) -> list[frozenset[str]]:
    """Sets of folded texts of which every match holds one text each: runs of ASCII literals, and for
    alternatives the union of one set of each."""
    sets: list[frozenset[str]] = []
    run = ""
    for op, value in [*items, (None, None)]:
        if op is _op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if op is _op.AT:
            continue
        if run:
            sets.append(frozenset([run]))
            run = ""
        if op is _op.SUBPATTERN:
            sets += _required(value[-1])
        elif op is _op.ATOMIC_GROUP:
            sets += _required(value)
        elif op in _REPEATS and value[0] >= 1:
            sets += _required(value[2])
        elif op is _op.BRANCH:
            each = [max(_required(b), key=lambda s: min(map(len, s)), default=None) for b in value[1]]
            if all(each):
                sets.append(frozenset().union(*each))
    return sets


def required_texts(pattern: str) -> list[frozenset[str]]:
    """Sets of texts, in small ASCII letters, of which every match of ``pattern`` holds one text each after
    :func:`fold`; none if there is nothing that all matches hold, or the pattern is not one of Python's."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _required(_parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return []


def index_texts(rules: list[LineRule]) -> list[frozenset[str] | None]:
    """For each rule the set it is looked up by, null if it must always be tried.

    Of a rule's sets, the one whose texts the fewest rules need is taken, then the one with the longest texts: what all
    rules share tells nothing about one of them. Texts below three characters come last.
    """
    needed = [required_texts(r.pattern) for r in rules]
    shared = Counter(t for sets in needed for t in frozenset().union(*sets))

    def worth(texts: frozenset[str]):
        shortest = min(map(len, texts))
        return shortest < 3, sum(shared[t] for t in texts), -shortest, sorted(texts)

    return [min(sets, key=worth, default=None) for sets in needed]


def _candidates(rules: list[LineRule]):
    """A function of languages and contents that gives the numbers, from 0, of the rules that may match."""
    of_text: dict[str, dict[str, list[int]]] = {}
    always: dict[str, list[int]] = {}
    for number, (rule, texts) in enumerate(zip(rules, index_texts(rules))):
        if texts is None:
            always.setdefault(rule.language, []).append(number)
        for t in texts or ():
            of_text.setdefault(rule.language, {}).setdefault(t, []).append(number)

    def tried(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        finders = {}
        for language, texts in of_text.items():
            finders[language] = ahocorasick.Automaton()
            for t in texts:
                finders[language].add_word(t, t)
            finders[language].make_automaton()

        def one(language, content):
            if content is None or language is None:
                return []
            numbers = set(always.get(language, ()))
            if language in finders:
                for t in {t for _, t in finders[language].iter(fold(content))}:
                    numbers.update(of_text[language][t])
            return sorted(numbers)

        for languages, contents in batches:
            yield pd.Series([one(a, b) for a, b in zip(languages, contents)])

    # Costly and pure: named non-deterministic so that it is computed once, not again in a filter.
    return F.pandas_udf(tried, T.ArrayType(T.IntegerType())).asNondeterministic()


def apply_many_rules(files: DataFrame, rules: list[LineRule], content: str = "content") -> DataFrame:
    """What :func:`repolens.operators.lines.apply_line_rules` finds, for rules by the thousand.

    Contents are looked through where they are read and are not shuffled. Patterns are a literal of the plan, tried rule
    by rule, so each is compiled once per file it may match; the texts of a finding are joined from the rules at the
    end. Null contents, and files of other languages, have no findings; no rules give none.
    """
    spark = files.sparkSession
    if not rules:
        rules = [LineRule("none", "", "", "", "", "", "", 0.0)]
    array = lambda values, type_: F.from_json(F.lit(json.dumps(values)), f"array<{type_}>")
    patterns, redacts = array([r.java for r in rules], "string"), array([r.redact for r in rules], "boolean")
    rows = files.select("repo_id", "path", F.col(content).alias("_text"), rule_language(F.col("path")).alias("_language"))
    rows = rows.where(F.col("_language").isNotNull()).withColumn("_tried", _candidates(rules)("_language", "_text"))
    rows = rows.where(F.size("_tried") > 0)
    is_py = F.col("_language") == "py"
    lines = F.transform(X.split_lines(F.col("_text")), lambda line, at: F.struct((at + 1).alias("number"), line.alias("line")))
    rows = rows.select("repo_id", "path", "_language", "_tried", F.filter(lines, lambda x: is_py | X.is_js_code(x["line"])).alias("_lines"))

    def evidence(rule, line):
        shown = X.strip(line)
        return F.when(F.get(redacts, rule), F.when(is_py, X.redact_py(shown)).otherwise(X.redact_js(shown))).otherwise(shown)

    def of_rule(rule):
        # Unlike rlike, regexp_instr keeps the last pattern it compiled.
        matched = F.filter("_lines", lambda x: F.regexp_instr(x["line"], F.get(patterns, rule)) > 0)
        return F.transform(
            matched,
            lambda x: F.struct(x["number"].alias("line_number"), (rule + 1).alias("_rule"), evidence(rule, x["line"]).alias("_evidence")),
        )

    found = rows.select("repo_id", "path", F.inline(F.flatten(F.transform("_tried", of_rule))))
    said = spark.createDataFrame(
        [(n, r.category, r.severity, r.title, r.description, r.suggested_fix, r.confidence) for n, r in enumerate(rules, 1)], _RULE_ROW
    )
    h = F.struct(
        F.col("_rule").alias("rule"), "category", "severity", "title", "description", F.col("_evidence").alias("evidence"), "suggested_fix", "confidence"
    )
    hits = F.array(F.struct("line_number", h.alias("h")))
    return hit_findings(found.join(said, "_rule").select("repo_id", "path", hits.alias("hits")))
