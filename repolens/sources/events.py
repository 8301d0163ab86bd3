"""Job events: messages in, per-job events out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from repolens import schemas
from repolens.functions.jsontext import parse_json


def parse_events(messages: DataFrame) -> DataFrame:
    """Events from text messages in ``value``; text that is no JSON becomes a ``raw`` event.

    Other columns are kept.
    """
    is_json = parse_json(F.col("value")).isNotNull()
    others = [c for c in messages.columns if c != "value"]
    rows = messages.select(*others, F.from_json("value", schemas.EVENTS).alias("e"), is_json.alias("ok"), "value").select(
        *others, "e.*", "ok", "value"
    )
    return rows.withColumns({
        "event": F.when(F.col("ok"), F.col("event")).otherwise(F.lit("raw")),
        "line": F.when(F.col("ok"), F.col("line")).otherwise(F.col("value")),
    }).drop("ok", "value")


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the events in the text files of a folder, one message per line."""
    return parse_events(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def write_events(
    events: DataFrame, path: str, checkpoint: str, buckets: int = 256, files_per_bucket: int = 1
) -> DataStreamWriter:
    """Writer that stores the events of a job in one of ``buckets`` folders.

    Folders per job would be as many as there are jobs. A reader of one job prunes by bucket; unlike
    a push to whoever listens, late readers find everything. A micro-batch writes at most
    ``files_per_bucket`` files to a folder; more of them spread jobs with very many events over tasks.
    """
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")
    slice_ = F.pmod(F.xxhash64(*events.columns), F.lit(files_per_bucket))
    bucketed = events.withColumns({"job_bucket": bucket, "_slice": slice_}).repartition("job_bucket", "_slice").drop("_slice")
    return (
        bucketed.writeStream.format("parquet").partitionBy("job_bucket")
        .option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    )


def read_job_events(spark: SparkSession, path: str, job_id: str, buckets: int = 256) -> DataFrame:
    bucket = F.pmod(F.xxhash64(F.lit(job_id)), F.lit(buckets)).cast("int")
    return spark.read.parquet(path).where((F.col("job_bucket") == bucket) & (F.col("job_id") == job_id))
