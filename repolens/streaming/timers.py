"""Job timeouts of a stream, by timers of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from repolens import constants as K

#: How far the clock stays behind the newest event, and how long a settled job is remembered.
DELAY = "10 minutes"
REMEMBER_SECONDS = 7 * 86_400
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ends_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per job of a batch, so that a job with very many events is few rows for its task."""
    for batch in batches:
        if batch.num_rows:
            least = pa.Table.from_batches([batch]).group_by("job_id").aggregate([("ts", "max"), ("at", "min"), ("ended", "min")])
            yield from least.select(["job_id", "ts_max", "at_min", "ended_min"]).rename_columns(["job_id", "ts", "at", "ended"]).to_batches()


class _Timer(StatefulProcessor):
    """Start and first end of a job in microseconds, until its deadline and a while after it."""

    def __init__(self, budget: int, remember: int):
        self.budget, self.remember = budget, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "started long, ended long, settled boolean")

    def _due(self, started: int) -> int:
        # Timers have milliseconds; the first one behind the deadline.
        return (started + self.budget) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.job.get() if self.job.exists() else None
        started, ended, settled = known if known else (None, None, False)
        if settled:
            return
        before = started
        for row in rows:
            started = row.at if started is None else min(started, row.at)
            if row.ended is not None:
                ended = row.ended if ended is None else min(ended, row.ended)
        if started != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(started))
        self.job.update((started, ended, False))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        started, ended, settled = self.job.get()
        if settled or not self.remember:
            self.job.clear()
        else:
            self.job.update((started, ended, True))
            self.handle.registerTimer(self._due(started) + self.remember)
        if not settled and (ended is None or ended > started + self.budget):
            yield Row(job_id=key[0], started=started)


def job_timeouts_stream(
    events: DataFrame, budget_seconds: int = K.JOB_BUDGET_SECONDS, delay: str = DELAY, remember_seconds: int = REMEMBER_SECONDS
) -> DataFrame:
    """``job_id, started`` of each job of a stream that had no done or error event within the budget, put out
    once, when the clock passes its deadline; no further event of the job is needed for that.

    The clock is the greatest ``ts`` so far less ``delay``. State is a row per job; it is dropped
    ``remember_seconds`` after the deadline. An event that comes later than that begins a job anew. Events
    without a job or a time count for nothing. Sets the state store the timers need in the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    at = F.unix_micros("ts")
    rows = events.where("job_id is not null and ts is not null").select(
        "job_id", "ts", at.alias("at"), F.when(F.col("event").isin("done", "error"), at).alias("ended")
    )
    rows = rows.mapInArrow(_ends_first, "job_id string, ts timestamp, at long, ended long").withWatermark("ts", delay)
    timer = _Timer(budget_seconds * 1_000_000, remember_seconds * 1000)
    late = rows.groupBy("job_id").transformWithState(timer, "job_id string, started long", "append", "eventTime")
    return late.withColumn("started", F.timestamp_micros("started"))
