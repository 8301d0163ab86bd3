"""Status logs: rows are never updated, every change is one more row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.operators.skew import previous


def moment(ts: str = "ts", seq: str = "seq") -> Column:
    """A number in the order of ``(ts, seq)``; a null time, then a null number, comes first.

    Microseconds take the digits above those of any long. As one number, a first or last moment is found by
    hash, without sorting rows.
    """
    time = F.coalesce(F.unix_micros(ts).cast("decimal(18,0)"), F.expr("-900000000000000000BD"))
    number = F.coalesce(F.col(seq).cast("decimal(19,0)"), F.expr("-9223372036854775809BD"))
    return (time * F.expr("20000000000000000000BD") + number).cast("decimal(38,0)")


def latest_state(log: DataFrame, key: str) -> DataFrame:
    """The last row of each entity by ``(ts, seq)``, which tell its rows apart; rows repeated in full count once.

    The last moment is found on narrow columns, the other columns are fetched for the rows that won.
    """
    last = log.groupBy(F.col(key).alias("_key")).agg(F.max(moment()).alias("_last"))
    won = log.join(last, F.col(key).eqNullSafe(F.col("_key")) & (moment() == F.col("_last")), "left_semi").distinct()
    return won.select(key, "ts", "seq", *[c for c in log.columns if c not in (key, "ts", "seq")])


def status_transitions(log: DataFrame, key: str) -> DataFrame:
    """``(key, ts, seq, from_status, status)``; the first state of an entity has no ``from_status``."""
    rows = log.select(key, "ts", "seq", "status")
    return previous(rows, [key], ["ts", "seq"], "status", "from_status")


def illegal_transitions(log: DataFrame, key: str, allowed: list[tuple[str, str]] = K.ALLOWED_MOVES) -> DataFrame:
    """Moves between two states that are not among the allowed ones."""
    moves = status_transitions(log, key).where(F.col("from_status").isNotNull())
    legal = F.lit(False)
    for before, after in allowed:
        legal = legal | ((F.col("from_status") == before) & (F.col("status") == after))
    return moves.where(~legal)
