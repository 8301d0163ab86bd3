"""Workflow tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens.schemas import conform

BUCKETS = 256


def append_table(df: DataFrame, path: str, schema: T.StructType, buckets: int = BUCKETS) -> None:
    """Append rows below ``repo_bucket=…`` folders.

    Rows are never updated: a status change is one more row, see :mod:`repolens.operators.lifecycle`.
    Rows of a bucket go to one file, or to as many of Spark's advisory size as a large repository asks for,
    which Spark decides as it writes.
    """
    rows = conform(df, schema).withColumn("repo_bucket", F.pmod(F.xxhash64("repo_id"), F.lit(buckets)).cast("int"))
    rows.hint("rebalance", "repo_bucket").write.mode("append").partitionBy("repo_bucket").parquet(path)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, repo_id: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """A table with its declared columns; with ``repo_id`` only that bucket's folder is read.

    ``buckets`` is the number the table was written with.
    """
    full = T.StructType([*schema.fields, T.StructField("repo_bucket", T.IntegerType())])
    rows = spark.read.schema(full).parquet(path)
    if repo_id is not None:
        bucket = F.pmod(F.xxhash64(F.lit(repo_id)), F.lit(buckets)).cast("int")
        rows = rows.where((F.col("repo_bucket") == bucket) & (F.col("repo_id") == repo_id))
    return rows.drop("repo_bucket")


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per row."""
    report.write.mode("overwrite").json(path)
