"""Corpora laid out by their key: tables in buckets of ``(repo_id, path)``.

Contents are shuffled once, when they are written. A join by the key then moves only its other side: the
buckets of the table are the partitions of the join.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["repo_id", "path"]
#: Contents of one bucket, which one task reads.
BUCKET_BYTES = 256 * 1024 * 1024
#: More buckets than this are refused by Spark unless ``spark.sql.sources.bucketing.maxBuckets`` is raised.
MOST_BUCKETS = 100_000


def buckets_for(files: DataFrame, content: str = "content", bucket_bytes: int = BUCKET_BYTES) -> int:
    """How many buckets hold ``bucket_bytes`` of contents each; at least the cores of the cluster, if there
    are as many files. Reads ``size`` in place of the contents if the table has it."""
    length = F.col("size") if "size" in files.columns else F.octet_length(content)
    total, rows = files.agg(F.sum(length.cast("double")), F.count(F.lit(1))).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return int(min(max(math.ceil((total or 0) / bucket_bytes), min(cores, rows), 1), MOST_BUCKETS))


def write_laid_out(files: DataFrame, table: str, path: str, buckets: int | None = None, content: str = "content") -> DataFrame:
    """Write ``files`` as the table ``table`` in ``path``, in buckets of its key, and read it.

    A bucket is one file: rows are dealt by the hash that names the buckets. As a key is one file of one
    repository, a large repository is spread over all buckets. Null keys share one bucket.
    """
    buckets = buckets or buckets_for(files, content)
    dealt = files.repartition(buckets, *KEY)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *KEY).saveAsTable(table)
    return files.sparkSession.table(table)


def open_laid_out(spark: SparkSession, table: str, path: str, schema: str, buckets: int) -> DataFrame:
    """A table that another session wrote: its name, columns and buckets are made known to this one's catalog."""
    quoted = "`" + table.replace("`", "``") + "`"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quoted} ({schema}) USING parquet "
        f"CLUSTERED BY ({', '.join(KEY)}) INTO {int(buckets)} BUCKETS LOCATION '{place}'"
    )
    return spark.table(quoted)


def beside(rows: DataFrame, laid_out: bool) -> DataFrame:
    """Narrow rows that are to meet contents by their key. Beside a laid-out table they are the hashed side of
    each bucket, so contents are neither shuffled nor sorted; otherwise Spark chooses by their size."""
    return rows.hint("shuffle_hash") if laid_out else rows
