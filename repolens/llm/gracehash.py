"""Exact deduplication by Grace hashing.

Each task first folds the copies it meets itself, so that a text shared by a third of all rows crosses
the shuffle once per table of a task at most. What is left is partitioned by bits of its hash. Partitions
too large for a table in memory are partitioned again by further bits, until each fits; the sizes come
from hashes and lengths alone, so texts are moved once, by their final bucket, into Spark's spill files.
A task then reads its buckets in order and gives each an open-addressing table that compares complete
contents, so equal hashes of different texts do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import blocks, stored, text_bytes

#: Bytes of different texts that one table holds.
TABLE_BYTES = 64 << 20
#: Bits of the hash by which a bucket is partitioned again.
STEP_BITS = 4
_SPACE = b" \t\n\v\f\r"


def normalized(text: bytes) -> bytes:
    """Each run of white space as one blank."""
    parts = []
    for block in blocks(text):
        words = block.split()
        parts.append((b" " if block[:1] and block[0] in _SPACE else b"") + b" ".join(words))
        if words and block[-1] in _SPACE:
            parts.append(b" ")
    out = b"".join(parts)
    # Blocks end after white space, and the next may start with more of it.
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


class ContentTable:
    """Open addressing with linear probing; a slot is equal only if hash and complete content are."""

    def __init__(self, slots: int = 1 << 10):
        self._slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def _place(self, hash_: int, content: bytes | None) -> int:
        mask = len(self._slots) - 1
        at = hash_ & mask
        while (entry := int(self._slots[at])) >= 0:
            if content is not None and self.hashes[entry] == hash_ and self.contents[entry] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, hash_: int, content: bytes) -> int:
        """The number of the entry of this content, a new one if it is not there."""
        if 2 * len(self.hashes) >= len(self._slots):
            self._slots = np.full(2 * len(self._slots), -1, np.int64)
            for entry, known in enumerate(self.hashes):
                self._slots[self._place(known, None)] = entry
        at = self._place(hash_, content)
        if self._slots[at] < 0:
            self._slots[at] = len(self.hashes)
            self.hashes.append(hash_)
            self.contents.append(content)
            self.bytes += len(content)
        return int(self._slots[at])


_FOLDED = pa.schema(
    [
        ("rid", pa.int64()), ("doc_id", pa.int64()), ("of", pa.int64()), ("sha", pa.string()),
        ("hash", pa.int64()), ("bytes", pa.int64()), ("content", pa.binary()),
    ]
)
_FOLDED_SQL = "rid long, doc_id long, of long, sha string, hash long, bytes long, content binary"


def _fold(table_bytes: int):
    """Rows as they come, numbered; ``of`` is the row that stands for a row's content in this table, and
    only that one carries the content."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        table, first, shas = ContentTable(), [], []
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                content = normalized(text)
                hash_ = xxhash.xxh64_intdigest(content)
                entry = table.add(hash_, content)
                signed = hash_ - (1 << 64) if hash_ >> 63 else hash_
                if entry == len(first):
                    first.append(rid)
                    shas.append(hashlib.sha256(content).hexdigest())
                    out.append((rid, doc_id, rid, shas[entry], signed, len(content), content))
                else:
                    out.append((rid, doc_id, first[entry], shas[entry], None, None, None))
                rid += 1
                if table.bytes > table_bytes:
                    table, first, shas = ContentTable(), [], []
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOLDED, strict=True)], schema=_FOLDED)

    return fold


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")


def _bucketed(parts: DataFrame, sizes: DataFrame, table_bytes: int) -> DataFrame:
    """``parts`` with columns ``depth, prefix`` naming its bucket: the shortest prefix of its hash whose
    different hashes have at most ``table_bytes`` bytes, or the whole hash."""
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    bits = max(0, (4 * total // table_bytes).bit_length())
    bits = min(60, -(-bits // STEP_BITS) * STEP_BITS)
    depth, prefix, open_ = F.lit(bits), _prefix(bits), sizes
    while bits < 64:
        large = open_.groupBy(_prefix(bits).alias("p")).agg(F.sum("bytes").alias("b")).where(F.col("b") > table_bytes)
        large = stored(large.select("p"), "large")
        if large.isEmpty():
            break
        open_ = stored(open_.withColumn("p", _prefix(bits)).join(large, "p", "left_semi").drop("p"), "open")
        mark = f"in_{bits}"
        parts = parts.withColumn("p", _prefix(bits)).join(large.withColumn(mark, F.lit(True)), "p", "left").drop("p")
        bits = min(64, bits + STEP_BITS)
        deeper = F.col(mark).isNotNull()
        depth = F.when(deeper, F.lit(bits)).otherwise(depth)
        prefix = F.when(deeper, _prefix(bits)).otherwise(prefix)
    return parts.select("rid", "hash", "content", depth.alias("depth"), prefix.alias("prefix"))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets in order, one table each: for each folded row, the first folded row of the same content."""
    bucket, table, first = None, ContentTable(), []
    for batch in batches:
        leads = []
        names = ("depth", "prefix", "rid", "hash")
        for depth, prefix, rid, hash_, content in zip(
            *(batch.column(c).to_pylist() for c in names), batch.column("content"), strict=True
        ):
            if (depth, prefix) != bucket:
                bucket, table, first = (depth, prefix), ContentTable(), []
            entry = table.add(hash_ & ((1 << 64) - 1), content.as_py())
            if entry == len(first):
                first.append(rid)
            leads.append(first[entry])
        yield pa.RecordBatch.from_arrays([batch.column("rid").cast(pa.int64()), pa.array(leads, pa.int64())], ["of", "lead"])


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` per row of ``docs``.

    Texts are equal when identical after replacing each run of white space by one blank; null counts as
    empty. The row with the smallest doc_id stays. Null ids come last: keep_id is null only if no row of
    the group has an id. Of rows repeated with the same id and text, one is kept. Further columns are not
    read. Empty input: no rows. Memory: tables of ``table_bytes``, or of one text if that is longer.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    folded = stored(named.mapInArrow(_fold(table_bytes), _FOLDED_SQL), "folded")
    heads = folded.where("rid = of")
    sizes = heads.groupBy("hash").agg(F.max("bytes").alias("bytes"))
    parts = _bucketed(heads.select("rid", "hash", "content"), sizes, table_bytes)
    dealt = parts.repartition("depth", "prefix").sortWithinPartitions("depth", "prefix")
    leads = stored(dealt.mapInArrow(_solve, "of long, lead long"), "leads")
    # Nulls last, then the smallest id, then the first row.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("rid").alias("row"))
    members = folded.groupBy("of").agg(F.min(order).alias("least"), F.count("*").alias("n")).join(leads, "of")
    groups = members.groupBy("lead").agg(F.min("least").alias("least"), F.sum("n").alias("group_size"))
    groups = leads.join(groups, "lead").select(
        "of", F.when(~F.col("least.none"), F.col("least.id")).alias("keep_id"), F.col("least.row").alias("keep_rid"), "group_size"
    )
    return folded.select("rid", "doc_id", "of", "sha").join(groups, "of").select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256")
    )
