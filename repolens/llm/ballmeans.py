"""Codes of vectors by product quantisation, its codebooks trained by ball k-means.

A ball is an entry with the parts assigned to it; its radius is the largest distance of one of them. After
entries moved, a part at distance d of its own entry can be as near to another only if the two entries are at
most 2 d apart. So only entries within twice the radius are a ball's neighbours. Sorted by their distance they
bound rings: parts in the stable core, nearer than half way to the first neighbour, keep their entry without
any further distance; a part in the k-th ring is compared with the first k neighbours. Everything is in exact
integers, with ties to the lower index, so that the result is that of comparing all entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens.llm.common import stored
from repolens.llm.voronoi import quantized

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
_LONG = (1 << 63) - 1


def _parts(column: pa.Array, parts: int, width: int, kind: type) -> np.ndarray:
    """Rows x parts x width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, width).astype(kind)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries that stand beside each other."""
    return ((x - entries) ** 2).sum(-1)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the nearest entry of each row, ties to the lower one, by comparing all."""
    best, at = _squares(x, book[0]), np.zeros(len(x), np.int64)
    for i in range(1, len(book)):
        square = _squares(x, book[i])
        less = np.asarray(square < best, bool)
        best[less], at[less] = square[less], i
    return at


class Balls:
    """A codebook with, for each entry, its neighbours by distance."""

    def __init__(self, book: np.ndarray, radius: list):
        apart = _squares(book[:, None], book[None])
        self.book, self.order, self.apart, self.n = book, np.zeros(apart.shape, np.int64), apart.copy(), np.zeros(len(book), np.int64)
        for i in range(len(book)):
            reach = [j for j in range(len(book)) if j != i and apart[i, j] <= 4 * radius[i]]
            reach.sort(key=lambda j: (apart[i, j], j))
            self.n[i] = len(reach)
            self.order[i, : len(reach)] = reach
            self.apart[i, : len(reach)] = [apart[i, j] for j in reach]

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, int]:
        """The nearest entry of each row, given the one it has; and how many distances that took."""
        best, at = _squares(x, self.book[own]), own.copy()
        four, took = 4 * best, len(x)
        active = np.arange(len(x))
        for k in range(int(self.n.max(initial=0))):
            # Rows whose ring lies outside the border to their k-th neighbour go on.
            mine = own[active]
            inside = (self.n[mine] > k) & np.asarray(self.apart[mine, k] <= four[active], bool)
            active = active[inside]
            if not len(active):
                break
            other = self.order[own[active], k]
            square = _squares(x[active], self.book[other])
            took += len(active)
            better = np.asarray(square < best[active], bool) | (np.asarray(square == best[active], bool) & (other < at[active]))
            best[active[better]], at[active[better]] = square[better], other[better]
        return at, took


def _clip(x) -> int:
    return min(int(x), _LONG)


def _each(work: Callable[[np.ndarray, np.ndarray], np.ndarray], parts: int, width: int, kind: type, books: np.ndarray | None = None):
    """Batches with codes replaced by ``work``'s; with ``books``, the error of the new codes instead of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(batch.column("v"), parts, width, kind)
            own = np.array([np.frombuffer(c, np.uint8) if c else np.zeros(parts, np.uint8) for c in batch.column("codes").to_pylist()]).astype(np.int64)
            codes = np.stack([work(p, x[:, p], own[:, p]) for p in range(parts)], 1)
            packed = pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())
            if books is None:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), packed], ["vec_id", "label", "v", "codes"])
            else:
                error = sum(_squares(x[:, p], books[p][codes[:, p]]) for p in range(parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), packed, pa.array([_clip(e) for e in error], pa.int64())],
                    ["vec_id", "label", "codes", "error"],
                )

    return run


def _sums(state: DataFrame, parts: int, width: int, kind: type, entries: int) -> dict:
    """Number and component sums of the parts of each used entry; tasks add up their own first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(batch.column("v"), parts, width, kind)
            own = np.array([np.frombuffer(c, np.uint8) for c in batch.column("codes").to_pylist()])
            for p in range(parts):
                block = np.zeros((entries, width), kind)
                np.add.at(block, own[:, p], x[:, p])
                count[p] += np.bincount(own[:, p], minlength=entries)
                total[p] += block.astype(object)
        at = [(p, e) for p, e in zip(*np.nonzero(count), strict=True)]
        if at:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(p) for p, _ in at for _ in range(width)], pa.int32()), pa.array([int(e) for _, e in at for _ in range(width)], pa.int32()),
                    pa.array([i for _ in at for i in range(width)], pa.int32()), pa.array([int(count[p, e]) for p, e in at for _ in range(width)], pa.int64()),
                    pa.array([Decimal(int(total[p, e, i])) for p, e in at for i in range(width)], pa.decimal128(38, 0)),
                ],
                ["part", "entry", "i", "n", "total"],
            )

    rows = state.select("v", "codes").mapInArrow(add, "part int, entry int, i int, n long, total decimal(38,0)")
    whole = rows.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
    return {(r.part, r.entry, r.i): (r.n, int(r.total)) for r in whole.collect()}


def _radii(state: DataFrame, parts: int, width: int, kind: type, books: np.ndarray) -> list[list]:
    """The squared radius of each ball; -1 without parts."""
    entries = books.shape[1]

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(batch.column("v"), parts, width, kind)
            own = np.array([np.frombuffer(c, np.uint8) for c in batch.column("codes").to_pylist()])
            for p in range(parts):
                square = _squares(x[:, p], books[p][own[:, p]])
                block = np.full(entries, -1, kind)
                np.maximum.at(block, own[:, p], square)
                for e in np.unique(own[:, p]):
                    far[p, int(e)] = max(far.get((p, int(e)), -1), int(block[e]))
        if far:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in far], pa.int32()), pa.array([e for _, e in far], pa.int32()), pa.array([Decimal(f) for f in far.values()], pa.decimal128(38, 0))],
                ["part", "entry", "far"],
            )

    rows = state.select("v", "codes").mapInArrow(most, "part int, entry int, far decimal(38,0)")
    out = [[-1] * entries for _ in range(parts)]
    for r in rows.groupBy("part", "entry").agg(F.max("far").alias("far")).collect():
        out[r.part][r.entry] = int(r.far)
    return out


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` per vector.

    Components become floor(scale * x); beyond a long they stop at its limits. Rows with a vector that is null
    or holds null or non-finite components, and rows of a null id, take no part. Shorter vectors count as
    filled with zeros, up to a length that the number of parts divides. Codebooks start with the parts of the
    vectors of the smallest ids (of rows that repeat an id, those first by their components); there are fewer
    entries if there are fewer rows. Rows that repeat are coded each. Errors beyond a long stop at its limit.
    Further columns are not read; the label may have any type that can be grouped. Empty input: no rows.

    To the driver go the codebooks and, a round, one row per component, and per ball; 256 entries at most.
    Every assignment is a written table.
    """
    if not 1 <= entries <= 256 or rounds < 1:
        raise ValueError("a code has one byte a part, and codebooks one round at least")
    whole = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), quantized(F.col(vector), scale).alias("v"))
    whole = whole.where("vec_id is not null and v is not null")
    least = F.least(F.array_min("v"), F.lit(0).cast("long")), F.greatest(F.array_max("v"), F.lit(0).cast("long"))
    seen = whole.agg(F.max(F.size("v")).alias("wide"), F.min(least[0]).alias("low"), F.max(least[1]).alias("high")).first()
    width = max(-(-(seen.wide or 0) // parts), 1)
    fill = F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("v"))
    whole = whole.withColumn("v", F.concat("v", fill))
    start = whole.select("vec_id", "v").orderBy("vec_id", "v").limit(entries).collect()
    span = (seen.high or 0) - (seen.low or 0)
    kind = np.int64 if 4 * width * (span + 1) ** 2 < 1 << 62 else object
    books = np.array([r.v for r in start], kind).reshape(len(start), parts, width).swapaxes(0, 1).copy()

    kept = stored(whole.withColumn("codes", F.lit(None).cast("binary")), "vectors")
    coded = T.StructType([f for f in kept.schema.fields if f.name != "v"] + [T.StructField("error", T.LongType())])
    shape, first = (parts, width, kind), books.copy()
    state = stored(kept.mapInArrow(_each(lambda p, x, own: nearest(x, first[p]), *shape), kept.schema), "codes")
    for last in (r == rounds - 1 for r in range(rounds)):
        for (p, e, i), (n, total) in _sums(state, *shape, len(start)).items():
            books[p, e, i] = total // n
        radii = _radii(state, *shape, books)
        balls = [Balls(book.copy(), radius) for book, radius in zip(books, radii, strict=True)]
        work = lambda p, x, own, balls=balls: balls[p].assign(x, own)[0]
        if last:
            state = stored(state.mapInArrow(_each(work, *shape, books.copy()), coded), "coded")
        else:
            state = stored(state.mapInArrow(_each(work, *shape), kept.schema), "codes")
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()
    sums = state.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = stored(sums, "label-errors")
    total = F.least("total", F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    return state.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", total.alias("label_error"), F.lit(digest).alias("codebooks_sha256")
    )
