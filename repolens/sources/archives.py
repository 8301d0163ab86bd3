"""ZIP archives as rows, with all-or-nothing admission."""

from __future__ import annotations

import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.session import materialize

MEMBERS = (
    "archive STRING, ord BIGINT, member STRING, size BIGINT, content BINARY, crc_ok BOOLEAN, "
    "archive_bytes BIGINT, error STRING"
)
_BATCH_BYTES = 32 * 1024 * 1024
# What reading a damaged, encrypted or unknown member raises; the decoders' errors share no base class.
_DAMAGE = (
    zipfile.BadZipFile, zlib.error, lzma.LZMAError, OSError, EOFError, NotImplementedError, RuntimeError, ValueError,
    IndexError, struct.error, MemoryError,
)


def _limit(max_bytes: int | None) -> int:
    return K.MAX_ARCHIVE_BYTES if max_bytes is None else max_bytes


def read_archives(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """``(path, length, content)`` of ZIP files.

    The content of a file above ``max_bytes`` is never loaded: it is refused by its length.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)
    fits = F.col("length") <= _limit(max_bytes)
    small = found.where(fits).select("path", "length", "content")
    large = found.where(~fits).select("path", "length").withColumn("content", F.lit(None).cast("binary"))
    return small.unionByName(large)


def explode_archives(archives: DataFrame) -> DataFrame:
    """One row per member of each archive; an unreadable archive gives one row with ``error``, an empty
    one a row without member."""
    names = [f.split()[0] for f in MEMBERS.split(", ")]

    def batch(rows):
        columns = dict(zip(names, zip(*rows)))
        types = {"ord": pa.int64(), "size": pa.int64(), "archive_bytes": pa.int64(),
                 "content": pa.binary(), "crc_ok": pa.bool_()}
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[n], types.get(n, pa.string())) for n in names], names=names
        )

    def members(path, length, content):
        if content is None:
            yield path, 0, None, None, None, None, length, "too large"
            return
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if not z.infolist():
                    yield path, 0, None, 0, None, True, length, None
                for ord_, info in enumerate(z.infolist()):
                    if info.is_dir():
                        yield path, ord_, info.filename, 0, None, True, length, None
                        continue
                    try:
                        data = z.read(info)
                        yield path, ord_, info.filename, len(data), data, True, length, None
                    except _DAMAGE:
                        yield path, ord_, info.filename, info.file_size, None, False, length, None
        except _DAMAGE:
            yield path, 0, None, None, None, None, length, "not a zip archive"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for i in range(b.num_rows):
                for row in members(*(b.column(c)[i].as_py() for c in range(3))):
                    rows.append(row)
                    held += len(row[4] or b"")
                    if held > _BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    return archives.select("path", "length", "content").mapInArrow(expand, MEMBERS)


def _resolves_outside(member):
    """A path that climbs above its start; every such name also has ``..`` in it."""
    steps = F.transform(
        F.split(member, "/"),
        lambda p: F.when(p == "..", F.lit(-1)).when(p.isin("", "."), F.lit(0)).otherwise(F.lit(1)),
    )
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, s: F.struct((acc.at + s).alias("at"), F.least(acc.low, acc.at + s).alias("low")),
    ).low < 0


def archive_verdicts(members: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``(archive, reason)``: why an archive is refused, null if it is admitted.

    An archive is judged as a whole: size, then readability, then checksums, then the first member
    with an unsafe name. ``max_bytes`` is the limit the archives were read with.
    """
    name = F.col("member")
    unsafe = name.startswith("/") | F.contains(name, F.lit(".."))
    error = F.col("error") if "error" in members.columns else F.lit(None).cast("string")
    reason = (
        F.when(F.col("archive_bytes") > _limit(max_bytes), F.struct(F.lit(0).alias("rank"), F.lit("too large").alias("text")))
        .when(error.isNotNull(), F.struct(F.lit(1).alias("rank"), error.alias("text")))
        .when(~F.col("crc_ok"), F.struct(F.lit(2).alias("rank"), F.lit("corrupt").alias("text")))
        .when(unsafe, F.struct(F.lit(3).alias("rank"), F.lit("unsafe path").alias("text")))
        .when(_resolves_outside(name), F.struct(F.lit(3).alias("rank"), F.lit("path traversal").alias("text")))
    )
    found = members.select("archive", F.when(reason.isNotNull(), F.struct(reason.rank, F.col("ord"), reason.text.alias("text"))).alias("r"))
    return found.groupBy("archive").agg(F.min("r").alias("r")).select("archive", F.col("r.text").alias("reason"))


def admit_archives(members: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Members of the admitted archives, and ``(archive, reason)`` of the refused ones.

    The refused ones are few and narrow and are written first, so that Spark broadcasts them when it
    can and member contents are not shuffled.
    """
    refused = materialize(archive_verdicts(members, max_bytes).where(F.col("reason").isNotNull()), "refused")
    return members.join(refused.select("archive"), "archive", "left_anti"), refused


def _roots(members: DataFrame) -> DataFrame:
    """``(archive, root)`` of the archives with one top-level entry which is a directory."""
    top = F.substring_index("member", "/", 1)
    tops = members.groupBy("archive").agg(
        F.min(top).alias("root"), F.max(top).alias("_high"),
        F.bool_or(~F.contains(F.col("member"), F.lit("/"))).alias("_file"),
    )
    return tops.where((F.col("root") == F.col("_high")) & ~F.col("_file")).select("archive", "root")


def _below_root(member, root):
    return F.when(root.isNull(), member).otherwise(F.substring(member, F.length(root) + 2, F.length(member)))


def unwrap_root(members: DataFrame) -> DataFrame:
    """Adds ``path``: the member name without the single top-level directory of its archive.

    The roots are one narrow row per archive, written first, so that Spark knows their size: below its broadcast
    threshold member contents stay where they are.
    """
    joined = members.join(materialize(_roots(members), "roots"), "archive", "left")
    return joined.withColumn("path", _below_root(F.col("member"), F.col("root"))).drop("root")


def archive_files(members: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``files`` rows of the admitted archives; the archive's name is the repository.

    Verdict and root are one narrow row per archive, written first: while that table is below the
    broadcast threshold the member contents stay where they are. ``members`` should be a written
    table, as it is read three times.
    """
    outcome = archive_verdicts(members, max_bytes).where(F.col("reason").isNull()).join(_roots(members), "archive", "left")
    outcome = materialize(outcome, "archives")
    return (
        members.where(F.col("content").isNotNull()).join(outcome, "archive")
        .select(F.col("archive").alias("repo_id"), _below_root(F.col("member"), F.col("root")).alias("path"), "size", "content")
    )
