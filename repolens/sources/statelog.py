"""Append-only status logs that are compacted: a snapshot of latest states, and the rows since.

Layout below a path, in a file system all executors share::

    tail/append=n/bucket=b/…        rows of the n-th append
    snapshot/upto=n.k/bucket=b/…    last row of each entity of bucket b over all appends up to n; the k-th such run,
                                    as other buckets may be compacted later without another append

A bucket's state is its newest whole snapshot and the appends after it, so reading costs the entities and what came
since, not the history. A folder counts only with the ``_SUCCESS`` that Spark writes last: a job that died in between
has changed nothing, and is repeated. One writer appends and compacts; any number read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens.operators.lifecycle import latest_state

BUCKETS = 256


def _kind(folder: str) -> str:
    """``tail`` or ``snapshot``, of the folder of a bucket."""
    return folder.rsplit("/", 3)[1]


#: Before every append.
_NONE = (-1, 0)


def _number(name: str) -> tuple[int, int]:
    """``append=3`` is (3, 0), ``upto=3.1`` is (3, 1)."""
    whole, _, run = name.split("=")[1].partition(".")
    return int(whole), int(run or 0)


class StateLog:
    """A log of rows with ``key``, ``ts`` and ``seq``, the last of which by ``(ts, seq)`` is an entity's state.

    ``buckets`` is fixed for a log's life. A null key is an entity of its own.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def append(self, rows: DataFrame, number: int) -> None:
        """Store rows as the append ``number``; a repeated one replaces its rows. Numbers ascend, as those of
        micro-batches do: one that a snapshot already holds is refused."""
        held = max(self._whole("snapshot"), default=_NONE)[0]
        if number <= held:
            raise ValueError(f"append {number} is not after {held}, which a snapshot already holds")
        self._write(rows, f"tail/append={number}")

    def latest(self) -> DataFrame:
        """The last row of each entity."""
        return latest_state(self._rows(self._plan()), self.key).select(*self.schema.names)

    def history(self) -> DataFrame:
        """All rows that are still there: what a snapshot has taken in shows as the last row of each entity."""
        return self._rows(self._plan())

    def compact(self, min_appends: int = 1) -> list[int]:
        """Give buckets with at least ``min_appends`` appends since their snapshot a new one, and name them.

        Only those buckets are read. Rows before the new snapshots stay until :meth:`forget`.
        """
        plan = {b: folders for b, folders in self._plan().items() if len([f for f in folders if _kind(f) == "tail"]) >= min_appends}
        if plan:
            upto = max(self._whole("tail"))[0]
            run = len([n for n in self._whole("snapshot") if n[0] == upto])
            self._write(latest_state(self._rows(plan), self.key), f"snapshot/upto={upto}.{run}")
        return sorted(plan)

    def forget(self) -> int:
        """Delete the folders no state needs any more, and count them. Readers that planned before the last
        :meth:`compact` must have ended."""
        needed = {f for folders in self._plan().values() for f in folders}
        old = [f for kind in ("tail", "snapshot") for folders in self._folders(kind).values() for f in folders.values() if f not in needed]
        for folder in old:
            path = self._path(folder)
            path.getFileSystem(self._conf()).delete(path, True)
        return len(old)

    def _write(self, rows: DataFrame, folder: str) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        dealt = rows.select(*self.schema.names).withColumn("bucket", bucket).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def _glob(self, pattern: str) -> list[str]:
        path = self._path(f"{self.path}/{pattern}")
        return [f.getPath().toString() for f in path.getFileSystem(self._conf()).globStatus(path) or []]

    def _whole(self, kind: str) -> set[tuple[int, int]]:
        """The numbers of the appends or snapshots that were written to the end."""
        return {_number(f.rsplit("/", 2)[1]) for f in self._glob(f"{kind}/*=*/_SUCCESS")}

    def _folders(self, kind: str) -> dict[int, dict[tuple[int, int], str]]:
        """Bucket to number to folder. The names of folders only: buckets times what was not yet compacted."""
        whole, found = self._whole(kind), {}
        for folder in self._glob(f"{kind}/*=*/bucket=*"):
            number, bucket = _number(folder.rsplit("/", 2)[1]), int(folder.rsplit("bucket=", 1)[1])
            if number in whole:
                found.setdefault(bucket, {})[number] = folder
        return found

    def _plan(self) -> dict[int, list[str]]:
        """The folders that make up each bucket: its newest snapshot, and the appends after it."""
        tails, snapshots, plan = self._folders("tail"), self._folders("snapshot"), {}
        for bucket in tails.keys() | snapshots.keys():
            upto = max(snapshots.get(bucket, {}), default=_NONE)
            base = [snapshots[bucket][upto]] if upto != _NONE else []
            plan[bucket] = base + [f for n, f in sorted(tails.get(bucket, {}).items()) if n[0] > upto[0]]
        return plan

    def _rows(self, plan: dict[int, list[str]]) -> DataFrame:
        parts = []
        for kind in ("snapshot", "tail"):
            folders = [f for fs in plan.values() for f in fs if _kind(f) == kind]
            if folders:
                parts.append(self.spark.read.schema(self.schema).parquet(*folders))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)
