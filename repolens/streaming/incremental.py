"""Analysis of files as they arrive.

A stream of files becomes two tables: facts, and findings of the file-local rules. A missing test can
only be told from all files of a repository, so those findings are computed from the facts table when
it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from repolens.operators import factrules
from repolens.operators.facts import FILE_FACTS
from repolens.operators.findings import dedup_findings, python_files, scan_files, scanned_findings
from repolens.schemas import FINDINGS, STRING, struct
from repolens.session import materialize

KEY = struct(repo_id=STRING, path=STRING)


def last_versions(files: DataFrame, order: str) -> DataFrame:
    """``files`` without those of which a version of greater ``order`` is there; equal ones all stay.

    Contents are not moved for it: what is superseded is found on narrow columns and written first, so Spark
    knows how few rows they are.
    """
    versions = files.select(F.col("repo_id").alias("_repo"), F.col("path").alias("_path"), F.col(order).alias("_order"))
    last = versions.groupBy("_repo", "_path").agg(F.max("_order").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    old = materialize(versions.join(last, ["_repo", "_path"]).where("_order < _last").drop("_last").distinct(), "superseded")
    same = (F.col("repo_id") == F.col("_repo")) & (F.col("path") == F.col("_path")) & (F.col(order) == F.col("_order"))
    return files.join(old, same, "left_anti")


def analyze_stream(files: DataFrame, out: str, checkpoint: str, order: str | None = None) -> DataStreamWriter:
    """Writer of ``out/arrivals``, ``out/facts`` and ``out/findings``; every micro-batch replaces its
    own folders, so a repeated batch leaves no rows twice.

    Of versions of a file in different micro-batches the last one counts. Of those in one micro-batch that of
    the greatest ``order`` counts, a column such as the time a version was sent; without it, a stream must
    not send a file twice in one.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, lambda table: f"{out}/{table}/batch={batch_id}"
        # Contents are read once; arrivals are the files of the facts.
        scanned = scan_files(batch if order is None else last_versions(batch, order))
        scanned.write.mode("overwrite").parquet(folder("facts"))
        stored = spark.read.schema(scanned.schema).parquet(folder("facts"))
        stored.select("repo_id", "path").write.mode("overwrite").parquet(folder("arrivals"))
        scanned_findings(stored).write.mode("overwrite").parquet(folder("findings"))

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def _stored(spark: SparkSession, out: str, table: str, schema: T.StructType, path: str) -> DataFrame:
    """Rows of a table that belong to the last arrival of their file."""
    batch = T.StructField("batch", T.LongType())
    arrivals = spark.read.schema(T.StructType([*KEY.fields, batch])).parquet(f"{out}/arrivals")
    last = arrivals.groupBy("repo_id", F.col("path").alias(path)).agg(F.max("batch").alias("batch"))
    rows = spark.read.schema(T.StructType([*schema.fields, batch])).parquet(f"{out}/{table}")
    return rows.join(last, ["repo_id", path, "batch"], "left_semi").drop("batch")


def stored_facts(spark: SparkSession, out: str) -> DataFrame:
    return _stored(spark, out, "facts", T.StructType.fromDDL(FILE_FACTS), "path")


def stored_findings(spark: SparkSession, out: str) -> DataFrame:
    """All findings of the files that arrived so far, deduplicated."""
    local = _stored(spark, out, "findings", FINDINGS, "file_path")
    return dedup_findings(local.unionByName(factrules.untested_functions(python_files(stored_facts(spark, out)))))
