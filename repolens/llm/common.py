"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.session import materialize

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that separates words: blank, and the controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and gives Spark true sizes for its joins."""
    return materialize(df, f"llm-{name}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, prefixed until they clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def text_bytes(array: pa.Array) -> Iterator[bytes]:
    """The UTF-8 of each text of a batch; a null is empty."""
    for x in array.cast(pa.large_binary()) if array.type != pa.binary() else array:
        yield x.as_py() or b""


def blocks(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in blocks of about ``size`` bytes, cut after white space, so that no word is cut.

    A word longer than a block stays whole.
    """
    at, end = 0, len(text)
    while at < end:
        stop = at + size
        while stop < end and text[stop - 1] not in b" \t\n\v\f\r":
            cut = max(text.rfind(c, at, stop) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
            stop = cut + 1 if cut >= at else stop + size
        yield text[at : min(stop, end)]
        at = stop


def drawn(count: int, most: int, seed: int) -> np.ndarray:
    """The places below ``count`` if there are no more than ``most``; else ``most`` of them, drawn from all
    alike; the same for the same seed. Ascending."""
    if count <= most:
        return np.arange(count)
    order = np.random.default_rng(seed).random(count)
    return np.sort(np.argsort(order, kind="stable")[:most])


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder
