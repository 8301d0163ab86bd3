"""Running a stream over what is there, into files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from repolens.session import ensure_checkpoint_dir

#: Buckets of keys that streams store rows in.
BUCKETS = 64


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_available(writer: DataStreamWriter) -> None:
    """Process all data that is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def to_files(rows: DataFrame, mode: str, name: str) -> DataFrame:
    """The rows a stream puts out, with ``batch``: every micro-batch replaces its own folder."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, name)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    writer = rows.writeStream.outputMode(mode).foreachBatch(store)
    run_available(writer.option("checkpointLocation", f"{folder}/state"))
    return spark.read.schema(_with_batch(rows.schema)).parquet(f"{folder}/out")


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


class _Buckets:
    """Rows of a stream below ``bucket=…/batch=…`` folders, by the hash of a key.

    A micro-batch writes the folders of its buckets, and reads those buckets only: what other keys have
    stored so far costs it nothing. A repeated one replaces its own folders.
    """

    def __init__(self, folder: str, schema: T.StructType, keys: list[str], buckets: int):
        self.folder, self.schema, self.keys, self.buckets = folder, schema, keys, buckets

    def _numbered(self) -> T.StructType:
        return T.StructType([*_with_batch(self.schema).fields, T.StructField("bucket", T.IntegerType())])

    def write(self, rows: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        dealt = rows.withColumns({"bucket": bucket, "batch": F.lit(batch_id).cast("long")}).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.folder)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of these rows, which are ``buckets`` numbers at most."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        return [r.bucket for r in rows.select(bucket.alias("bucket")).distinct().collect()]

    def written(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, list[int]]:
        """The rows of a micro-batch, and their buckets, found by the names of its folders."""
        there = _folders(spark, f"{self.folder}/bucket=*/batch={batch_id}")
        return self._rows(spark, there), [int(p.split("bucket=")[-1].split("/")[0]) for p in there]

    def read(self, spark: SparkSession, touched: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, of which only the folders are listed."""
        wanted = None if touched is None else {f"bucket={b}" for b in touched}
        return self._rows(spark, [p for p in _folders(spark, f"{self.folder}/bucket=*") if wanted is None or p.rsplit("/", 1)[-1] in wanted])

    def _rows(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], _with_batch(self.schema))
        return spark.read.schema(self._numbered()).option("basePath", self.folder).parquet(*folders).drop("bucket")


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """The folders of a pattern, in whatever file system its path is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def refold(rows: DataFrame, key: str, fold: Callable[[DataFrame], DataFrame], name: str, buckets: int = BUCKETS) -> DataFrame:
    """What ``fold`` gives for the keys of each micro-batch over all their rows so far, with ``batch``.

    Rows are stored as they come, by buckets of the key, and a key that gets more of them is folded anew: an
    event is never too late, and the last row of a key is what the fold over the whole table gives. A
    repeated micro-batch replaces its own folders. Only the buckets of touched keys are read again; join and
    fold are shuffles that Spark can split, no state is held in memory.
    """
    folder, schema = new_folder(rows.sparkSession, name), rows.schema
    kept = _Buckets(f"{folder}/rows", schema, [key], buckets)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept.write(batch, batch_id)
        here, touched = kept.written(spark, batch_id)
        stored = kept.read(spark, touched).where(F.col("batch") <= batch_id)
        fold(stored.drop("batch").join(here.select(key).distinct(), key, "left_semi")).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    run_available(rows.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/state"))
    spark = rows.sparkSession
    return spark.read.schema(_with_batch(fold(spark.createDataFrame([], schema)).schema)).parquet(f"{folder}/out")


def first_of_each(rows: DataFrame, keys: list[str], name: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a stream whose keys no earlier micro-batch had, one for each; nulls are equal. A micro-batch
    meets the keys of its own buckets only."""
    folder = new_folder(rows.sparkSession, name)
    kept = _Buckets(f"{folder}/out", rows.schema, keys, buckets)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, fresh = batch.sparkSession, batch.dropDuplicates(keys)
        seen = kept.read(spark, kept.touched(batch)).where(F.col("batch") < batch_id)
        seen = seen.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        kept.write(fresh.join(seen, same, "left_anti"), batch_id)

    run_available(rows.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/state"))
    return kept.read(rows.sparkSession).drop("batch")


def last_update(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key of a stream in update or complete mode."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    last = F.max_by(F.struct(*rest), "batch")
    return rows.groupBy(key).agg(last.alias("r")).select(key, "r.*")
