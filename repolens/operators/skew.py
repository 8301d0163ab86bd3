"""Row numbers and previous rows that hold when one key has a large share of all rows.

All rows are cut into sorted ranges by key and order, whatever the sizes of keys. A key that goes on in the
next ranges leaves there a row with how many rows it has had, and its last value. So a position is the sum of
what earlier ranges report plus the place in the range, and no task holds more than a range. It is one pass
through two shuffles: nothing is counted beforehand, no job runs while a query is built, and no size changes the
plan. Joins are left to Spark, which splits skewed partitions of a join as it runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges at most; else as many as the session has shuffle partitions.
RANGES = 1000
#: Parts in which the first rows of a key are looked for, before those of the parts are compared.
PARTS = 64
_OWN = T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_target", T.IntegerType()), T.StructField("_weight", T.LongType())])


def _columns(order: list) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _in_ranges(df: DataFrame, keys: list[str], order: list[Column], value: str | None, ranges: int | None) -> DataFrame:
    """``df`` with ``_range`` and ``_target``, which are the number of a row's range, and ``_weight`` 1; and for the last
    key of each range one row per later range as ``_target``, with the number of its rows as ``_weight``, in
    which only the keys and ``value`` are set."""
    ranges = ranges or max(1, min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kept, names = {*keys, value}, [*df.columns, *_OWN.names]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, last_key, count, schema = TaskContext.get().partitionId(), None, None, 0, None

        def numbered(columns: list, n: int, targets: pa.Array, weight: int) -> pa.RecordBatch:
            numbers = [pa.array([own] * n, pa.int32()), targets, pa.array([weight] * n, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *numbers], names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            yield numbered(batch.columns, n, pa.array([own] * n, pa.int32()), 1)
            schema, last = batch.schema, batch.slice(n - 1, 1)
            key, run = [last.column(k)[0] for k in keys], None
            for k, x in zip(keys, key, strict=True):
                column = batch.column(k)
                same = pc.fill_null(pc.equal(column, x), False) if x.is_valid else pc.is_null(column)
                run = same if run is None else pc.and_(run, same)
            here = pc.sum(run).as_py()
            key = [x.as_py() for x in key]
            count = here + (count if key == last_key else 0)
            last_key = key
        later = list(range(own + 1, ranges))
        if last is not None and later:
            first = pa.array([0] * len(later))
            columns = [c.take(first) if f.name in kept else pa.nulls(len(later), f.type) for f, c in zip(schema, last.columns, strict=True)]
            yield numbered(columns, len(later), pa.array(later, pa.int32()), count)

    # The number of ranges is given, so Spark does not merge them as it runs.
    by = [F.col(k) for k in keys]
    cut = df.repartitionByRange(ranges, *by, *order).sortWithinPartitions(*by, *order)
    nullable = [T.StructField(f.name, f.dataType) for f in df.schema]
    return cut.mapInArrow(deal, T.StructType([*nullable, *_OWN.fields]))


def ordinal(df: DataFrame, keys: list[str], order: list, out: str = "ordinal", ranges: int | None = None) -> DataFrame:
    """1-based position of each row within its key; ``order`` must be total. No rows: no rows."""
    order = _columns(order)
    within = Window.partitionBy("_target", *keys).orderBy("_range", *order).rowsBetween(Window.unboundedPreceding, 0)
    placed = _in_ranges(df, keys, order, None, ranges).withColumn(out, F.sum("_weight").over(within).cast("bigint"))
    return placed.where("_range = _target").select(*[c for c in df.columns if c != out], out)


def previous(df: DataFrame, keys: list[str], order: list, value: str, out: str, ranges: int | None = None) -> DataFrame:
    """``value`` of the row before, within the key; null on the first row."""
    order = _columns(order)
    within = Window.partitionBy("_target", *keys).orderBy("_range", *order)
    moved = _in_ranges(df, keys, order, value, ranges).withColumn(out, F.lag(value).over(within))
    return moved.where("_range = _target").select(*df.columns, out)


def first_rows(df: DataFrame, keys: list[str], order: list, n: int, spread_by: list[str], parts: int = PARTS) -> DataFrame:
    """The first ``n`` rows of each key: those of each of its parts first, so that no task sorts a whole key, then
    of these."""
    order = _columns(order)
    place = lambda *by: F.row_number().over(Window.partitionBy(*keys, *by).orderBy(*order))
    part = F.pmod(F.xxhash64(*spread_by), F.lit(parts))
    df = df.withColumn("_part", part).withColumn("_at", place("_part")).where(F.col("_at") <= n).drop("_part")
    return df.withColumn("_at", place()).where(F.col("_at") <= n).drop("_at")
