"""Changed files between two snapshots, and diff texts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens.session import materialize
from repolens.sources.layout import beside


def changed_files(before: DataFrame, after: DataFrame, content: str = "content") -> DataFrame:
    """``(repo_id, path, change)`` with change added, removed or modified.

    Contents are hashed where they are read; only the hashes are shuffled.
    """
    side = lambda df, name: df.select("repo_id", "path", F.sha2(F.col(content).cast("binary"), 256).alias(name))
    both = side(before, "old").join(side(after, "new"), ["repo_id", "path"], "full_outer")
    change = (
        F.when(F.col("old").isNull(), F.lit("added"))
        .when(F.col("new").isNull(), F.lit("removed"))
        .when(F.col("old") != F.col("new"), F.lit("modified"))
    )
    return both.select("repo_id", "path", change.alias("change")).where(F.col("change").isNotNull())


@F.pandas_udf(T.StringType())
def diff_text(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    """Unified diff of two texts, '' if they are equal; null stands for no file."""

    def one(p, old, new):
        names = ("/dev/null" if old is None else f"a/{p}", "/dev/null" if new is None else f"b/{p}")
        lines = [[] if text is None else text.split("\n") for text in (old, new)]
        return "\n".join(difflib.unified_diff(*lines, *names, lineterm=""))

    return pd.Series([one(p, b, a) for p, b, a in zip(path, before, after)])


def unified_diff(changed: DataFrame) -> DataFrame:
    """Adds ``diff`` to ``(repo_id, path, before, after)``; rows of equal texts are left out.

    Lines are cut at newlines, so a missing newline at the end shows as a removed empty line.
    """
    rows = changed.where(~F.col("before").eqNullSafe(F.col("after")))
    return rows.withColumn("diff", diff_text(F.col("path"), F.col("before"), F.col("after")))


def snapshot_diff(before: DataFrame, after: DataFrame, content: str = "content", laid_out: bool = False) -> DataFrame:
    """Diffs of the changed files of two snapshots; contents of other files are not shuffled.

    The keys of the changed files are written first, so Spark knows their size: below its broadcast
    threshold both snapshots are cut down to the changed files where they are read. If both are tables of
    :mod:`repolens.sources.layout` with equally many buckets (``laid_out``), no content is ever shuffled, and hashes
    are compared bucket by bucket.
    """
    keys = beside(materialize(changed_files(before, after, content).select("repo_id", "path"), "changed"), laid_out)
    of = lambda df, name: df.select("repo_id", "path", F.col(content).alias(name)).join(
        keys, ["repo_id", "path"], "left_semi"
    )
    return unified_diff(of(before, "before").join(of(after, "after"), ["repo_id", "path"], "full_outer"))


def diff_stat(diffs: DataFrame) -> DataFrame:
    """``(repo_id, path, added, removed)``: changed lines counted in ``diff``."""
    lines = F.slice(F.split("diff", "\n"), 3, F.length("diff") + 1)
    count = lambda sign: F.size(F.filter(lines, lambda l: l.startswith(sign))).cast("bigint")
    return diffs.select("repo_id", "path", count("+").alias("added"), count("-").alias("removed"))
