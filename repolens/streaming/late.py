"""Rows of a stream that come late, in a table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

_MARK = "top timestamp, batch long"


def split_late(rows: DataFrame, out: str, checkpoint: str, time: str = "ts", delay_seconds: int = 600) -> DataStreamWriter:
    """Writer of ``out/on_time`` and ``out/late``: a row is late if it is more than ``delay_seconds`` older than the
    greatest time of earlier micro-batches. No row is lost; one without a time is on time.

    Each micro-batch stores the greatest time so far, and the next one reads that one row, so its work
    does not grow with the stream; a repeated micro-batch replaces its own folders and sees the same mark.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([(None, -1)], _MARK).select("top").write.mode("ignore").parquet(f"{out}/marks/batch=-1")
        marks = spark.read.schema(_MARK).parquet(f"{out}/marks").where(F.col("batch") == batch_id - 1)
        top = marks.agg(F.max("top").alias("top"))
        late = F.coalesce(F.col(time) < F.timestamp_add("SECOND", F.lit(-delay_seconds), top.scalar()), F.lit(False))
        # The batch is read once: dealt in two folders by what it is, its greatest time from what was written.
        batch.withColumn("_late", late).write.mode("overwrite").partitionBy("_late").parquet(f"{out}/rows/batch={batch_id}")
        written = spark.read.schema(_written(batch.schema)).parquet(f"{out}/rows").where(F.col("batch") == batch_id)
        greatest = written.agg(F.max(time).alias("top")).unionByName(top).agg(F.max("top").alias("top"))
        greatest.coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/batch={batch_id}")

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def _written(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("_late", T.BooleanType())])


def read_split(spark: SparkSession, out: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows on time, and the late ones, each with the ``batch`` they came in."""
    rows = spark.read.schema(_written(schema)).parquet(f"{out}/rows")
    return rows.where("not _late").drop("_late"), rows.where("_late").drop("_late")
