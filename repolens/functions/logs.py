"""Counts read out of test logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(log: Column, word: str) -> Column:
    digits = F.regexp_extract(log, rf"(\d+) {word}", 1)
    return F.when(digits == "", F.lit(0)).otherwise(F.coalesce(digits.try_cast("int"), F.lit(0)))


def parse_test_log(log: Column) -> Column:
    """``struct(total, passed, failed)``; errors count as failed, skipped tests do not count."""
    passed = _count(log, "passed")
    failed = _count(log, "failed") + _count(log, "error")
    return F.struct((passed + failed).alias("total"), passed.alias("passed"), failed.alias("failed"))
