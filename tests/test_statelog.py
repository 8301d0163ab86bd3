"""Compacted logs: the states of the whole log before, between and after compactions, and little to read."""

import pytest
from pyspark.sql import functions as F

from repolens.operators.lifecycle import latest_state
from repolens.sources.statelog import StateLog

SCHEMA = "job_id string, ts timestamp, seq long, status string, note string"


def make(spark, n, start=0):
    """Rows of some entities; one entity has a third of them, one has no name, times tie and come out of order."""
    rows = spark.range(start, start + n)
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 31 == 1, None).otherwise(F.concat(F.lit("j"), F.col("id") % 40))
    ts = F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(50)))
    return rows.select(key.alias("job_id"), ts.alias("ts"), F.col("id").alias("seq"), F.concat(F.lit("s"), F.col("id") % 7).alias("status"), F.repeat(F.lit("n"), 50).alias("note"))


def states(df):
    return sorted(map(tuple, df.select("job_id", "ts", "seq", "status", "note").collect()), key=str)


@pytest.fixture
def log(spark, tmp_path):
    # A path that itself has the names of the folders.
    return StateLog(spark, str(tmp_path / "tail" / "snapshot" / "log"), make(spark, 1).schema, "job_id", buckets=8)


def test_states_at_every_moment(spark, log):
    whole = make(spark, 0)
    for n in range(6):
        part = make(spark, 200, 200 * (5 - n))
        log.append(part, n)
        whole = whole.unionByName(part)
        expected = states(latest_state(whole, "job_id"))
        assert states(log.latest()) == expected
        if n in (1, 2, 4):
            assert log.compact() != []
            assert states(log.latest()) == expected
            assert log.compact() == []
        if n == 4:
            assert log.forget() > 0
            assert states(log.latest()) == expected
    assert len(expected) == whole.select("job_id").distinct().count()


def test_reading_follows_the_entities(spark, log):
    for n in range(5):
        log.append(make(spark, 1000, 1000 * n), n)
    entities = log.latest().count()
    assert log.history().count() == 5000
    log.compact()
    assert log.history().count() == entities
    log.append(make(spark, 10, 9000), 5)
    assert log.history().count() == entities + 10


def test_only_buckets_with_enough_appends(spark, log):
    log.append(make(spark, 500), 0)
    log.compact()
    one = make(spark, 500, 500).where("job_id = 'hot'")
    log.append(one, 1)
    log.append(make(spark, 300, 1000), 2)
    done = log.compact(min_appends=2)
    assert len(done) == 1
    whole = make(spark, 500).unionByName(one).unionByName(make(spark, 300, 1000))
    assert states(log.latest()) == states(latest_state(whole, "job_id"))
    log.forget()
    assert states(log.latest()) == states(latest_state(whole, "job_id"))
    assert len(log.compact()) >= 1
    assert states(log.latest()) == states(latest_state(whole, "job_id"))


def test_work_that_did_not_end_counts_for_nothing(spark, log, tmp_path):
    log.append(make(spark, 300), 0)
    log.append(make(spark, 300, 300), 1)
    expected = states(log.latest())
    log.compact()
    # A snapshot, and an append, whose job died before its last step.
    base = tmp_path / "tail" / "snapshot" / "log"
    (base / "snapshot" / "upto=1.0" / "_SUCCESS").unlink()
    log._write(make(spark, 50, 5000), "tail/append=2")
    (base / "tail" / "append=2" / "_SUCCESS").unlink()
    assert states(log.latest()) == expected
    log.compact()
    assert states(log.latest()) == expected


def test_a_repeated_append_replaces_its_rows(spark, log):
    log.append(make(spark, 900), 3)
    log.append(make(spark, 90), 3)
    assert states(log.latest()) == states(latest_state(make(spark, 90), "job_id"))
    log.compact()
    for number in (2, 3):
        with pytest.raises(ValueError, match="already holds"):
            log.append(make(spark, 5), number)


def test_nothing(spark, log):
    assert log.latest().collect() == [] and log.compact() == [] and log.forget() == 0
    log.append(make(spark, 0), 0)
    assert log.latest().collect() == [] and log.compact() == []
    log.append(make(spark, 20), 1)
    assert states(log.latest()) == states(latest_state(make(spark, 20), "job_id"))
