"""Session helpers: checkpoint folder, spreading of small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master gets a folder of its own when none is named; on a cluster a folder of one
    machine would be lost with that machine.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        known = tempfile.mkdtemp(prefix="repolens-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result several branches read to the shared checkpoint folder, and read it back.

    Later branches read only the columns they need, and a lost executor costs no recomputation.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_small_input(df: DataFrame) -> DataFrame:
    """Cut a scan of fewer splits than cores into one file per core.

    Work on contents is CPU-bound, so one small file must not become one task. A split holds at most
    ``spark.sql.files.maxPartitionBytes``, so what is rewritten here is below that size per core;
    larger inputs have more splits and are left as they are. ``df`` must be a scan without shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return materialize(df.repartition(cores), "spread") if df.rdd.getNumPartitions() < cores else df
