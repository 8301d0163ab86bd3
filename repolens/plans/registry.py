"""Registry of queries: a job over a folder of tables, and the SQL it must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repolens.plans import derived
from repolens.session import spread_small_input

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SPREAD: dict[tuple[str, str, str], DataFrame] = {}


class Tables:
    """The derived tables of a folder by lower-case name, such as ``t.corpus``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return derived.load(self.spark, self.sf_dir, getattr(derived, name.upper()))

    @property
    def corpus(self) -> DataFrame:
        return self._spread("CORPUS")

    @property
    def corpus_after(self) -> DataFrame:
        return self._spread("CORPUS_AFTER")

    def _spread(self, name: str) -> DataFrame:
        """A derived corpus; one small enough to be spread is spread once per session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _SPREAD:
            _SPREAD[key] = spread_small_input(derived.load(self.spark, self.sf_dir, getattr(derived, name)))
        return _SPREAD[key]


def expand(sql: str) -> str:
    """Put the statement of a derived table in the place of its name in braces, such as {CORPUS}."""
    return derived.portable(re.sub(r"\{([A-Z_]+)\}", lambda m: f"({getattr(derived, m[1]).strip()})", sql))


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its own name."""

    def register(job: Callable[[Tables], DataFrame]):
        QUERIES[job.__name__] = lambda spark, sf_dir: job(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[job.__name__] = expand(sql).strip()
        return job

    return register


def literal(text: str) -> str:
    """A SQL text literal."""
    return "'" + text.replace("'", "''") + "'"


def choose(column: str, texts: dict[str, str], default: str) -> str:
    """A SQL CASE from names to texts."""
    cases = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in texts.items())
    return f"CASE {column} {cases} ELSE {literal(default)} END"
