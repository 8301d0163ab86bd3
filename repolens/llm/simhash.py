"""Near duplicates by SimHash, found with a grid range join over counts of bits in segments.

A fingerprint has 32 segments of two bits. The number of bits set in each (0, 1 or 2) is a point of a
32-dimensional grid, and the Manhattan distance of two such points is a lower bound of the number of
differing bits. Counts are kept as 00, 01, 11, so that this distance is the bit count of an exclusive or.
Within three bits, one half of the dimensions is within distance one: the join looks up a point's own
cell and the cells one step up in the 16 dimensions of either half, which meets each pair from one side.
Candidates pass the bound over all 32 dimensions, then the exact count of differing bits, in the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import blocks, fresh, same, stored, text_bytes
from repolens.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
_EVEN = 0x5555555555555555
_LOW = 0xFFFFFFFF


def _shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, by blocks of the text."""
    kept: list[bytes] = []
    found = False
    for block in blocks(text):
        kept += block.lower().split()
        n = len(kept) - words + 1
        if n > 0:
            found = True
            shingles = map(b" ".join, zip(*(kept[i : n + i] for i in range(words)), strict=True))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
            kept = kept[n:]
    if kept and not found:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], np.uint64)


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text as a signed 64-bit number; 0 without words."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes(text, words):
        for at in range(0, len(hashes), 1 << 14):
            part = hashes[at : at + (1 << 14)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits((ones * 2 > total).astype(np.uint8), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, name: str = "fp", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a long; a null text has 0."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x, words) for x in text_bytes(texts)], pa.int64())

    return docs.withColumn(name, simhash(F.col(text)))


def _counts(fp: Column) -> Column:
    """Bits set in each segment of two, as 00, 01 or 11."""
    next_bit = F.shiftrightunsigned(fp, 1)
    both, any_ = fp.bitwiseAND(next_bit).bitwiseAND(F.lit(_EVEN)), fp.bitwiseOR(next_bit).bitwiseAND(F.lit(_EVEN))
    return F.shiftleft(both, 1).bitwiseOR(any_)


def _probes(cell: Column) -> Column:
    """A cell of 16 dimensions, and the cells one step up in one of them."""
    steps = [
        F.when(
            cell.bitwiseAND(F.lit(3 << 2 * i)) != F.lit(3 << 2 * i),
            cell.bitwiseOR(F.shiftleft(cell.bitwiseAND(F.lit(1 << 2 * i)), 1)).bitwiseOR(F.lit(1 << 2 * i)),
        )
        for i in range(16)
    ]
    return F.array_compact(F.array(cell, *steps))


def near_pairs(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: each pair of different fingerprints of column ``fp`` (distinct, not null) that differ in
    at most ``max_bits`` bits, once."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the halves of the grid guarantee pairs up to 3 bits apart")
    points = prints.select("fp", _counts(F.col("fp")).alias("c"))
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.col("c").bitwiseAND(F.lit(_LOW)).alias("cell")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("c", 32).alias("cell")),
    )
    cells = points.select("fp", "c", F.inline(halves))
    key = F.shiftleft(F.col("half").cast("long"), 32)
    base = cells.select(F.col("fp").alias("b"), F.col("c").alias("cb"), key.bitwiseOR(F.col("cell")).alias("k"))
    probe = cells.select("fp", "c", "half", "cell", F.explode(_probes(F.col("cell"))).alias("to"))
    probe = probe.select(
        F.col("fp").alias("a"), F.col("c").alias("ca"), F.col("half").alias("h"),
        (F.col("to") == F.col("cell")).alias("own"), key.bitwiseOR(F.col("to")).alias("ka"),
    )
    apart = F.col("ca").bitwiseXOR(F.col("cb"))
    hit = (
        (F.col("ka") == F.col("k"))
        & (~F.col("own") | (F.col("a") < F.col("b")))
        & (F.bit_count(apart) <= max_bits)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        # The upper half reports only what the lower half misses.
        & ((F.col("h") == 0) | (F.bit_count(apart.bitwiseAND(F.lit(_LOW))) > 1))
    )
    return probe.join(base, hit).select("a", "b")


def near_duplicates(prints: DataFrame, doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """``prints`` (with columns ``fp`` and ``doc_id``) with ``component_id``: the smallest doc_id reachable
    over links of at most ``max_bits`` bits.

    Equal fingerprints are one node, so groups of copies cost one row. A null doc_id is linked like any
    other and never is a component's id, unless the component has no other. ``prints`` is read twice;
    store it first.
    """
    nodes = prints.groupBy("fp").agg(F.min(doc_id).alias("least_id"))
    roots = components(near_pairs(nodes, max_bits)).withColumnRenamed("node", "fp")
    grouped = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(grouped.join(least, "root").select("fp", "component_id"), "fp")


def simhash_groups(
    docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``doc_id, fp, text_hash, component_id`` per document.

    Null and empty texts, and texts without words, have fingerprint 0 and are linked like any other.
    Repeated rows give repeated rows. Further columns of ``docs`` are not read. Empty input: no rows.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = with_fingerprint(named, "fp", "text", words)
    prints = prints.withColumn("text_hash", F.xxhash64("text")).drop("text")
    return near_duplicates(stored(prints, "prints"), "doc_id", max_bits)


def keep_one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without the documents whose component has one with a smaller doc_id.

    Of rows repeated with the same doc_id, one stays. Columns are those of ``docs``; others than
    ``doc_id`` and ``text`` are passed through unread.
    """
    groups = stored(simhash_groups(docs, words, max_bits), "groups")
    kept = same(F.col("doc_id"), F.col("component_id"))
    i, h = fresh(docs, "drop_id", "drop_hash")
    keys = [F.col("doc_id").alias(i), F.col("text_hash").alias(h)]
    on = same(docs["doc_id"], F.col(i)) & (F.xxhash64(docs["text"]) == F.col(h))
    left = docs.join(groups.where(~kept).select(*keys).distinct(), on, "left_anti")
    # A component may hold several rows of its smallest id: rows of the same text, or of near texts.
    again = groups.where(kept).groupBy("component_id").agg(
        F.count("*").alias("n"), F.min("text_hash").alias("text_hash"), F.first("doc_id").alias("doc_id")
    )
    again = stored(again.where("n > 1").withColumnRenamed("component_id", "of"), "again")
    if again.isEmpty():
        return left
    every = groups.where(kept).join(again.select("of"), same(F.col("component_id"), F.col("of")), "left_semi")
    on_left = same(left["doc_id"], F.col(i)) & (F.xxhash64(left["text"]) == F.col(h))
    single = left.join(every.select(*keys).distinct(), on_left, "left_anti")
    one = left.join(again.select(*keys), on_left, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(one)
