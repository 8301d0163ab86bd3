"""Exact search for the largest inner products by a Voronoi join.

Vectors are grouped by their nearest pivot, and each group is summed up by its number of vectors, the
largest distance to the pivot and the largest norm. A query first meets one block of its own group, which
gives it a lower bound of its k-th score. With a pivot p and a radius r, q.x is at most q.p + |q| r, and
at most |q| times the largest norm: a query is sent only to the groups whose upper bound reaches its lower
bound. Groups are dealt in blocks of bounded size, so that one with a third of all vectors is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.llm.common import stored

#: Pivots, taken by hash of their ids from all vectors.
PIVOTS = 64
#: Vectors of a block, and queries that meet a block in one call.
BLOCK, QUERY_BLOCK = 4096, 1024
SCALE = 64
_EXACT = float(1 << 53)


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """Components as floor(scale * x); null for a vector that is null or has a null or non-finite one."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products; those beyond a long stop at its limits."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    most = np.abs(queries.astype(np.float64)).max() * np.abs(vectors.astype(np.float64)).max() * queries.shape[1]
    if most < _EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _nearest(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = vectors.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    cell = square.argmin(1)
    # From the difference itself: the expanded square loses digits.
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def _pick(cells: list[int], cell: str) -> Column:
    return F.element_at(F.array(*map(F.lit, cells)), F.col(cell) + 1)


def _solve(k: int, bounded: bool):
    """Top k of a block for each query; with a bound, only scores that reach it."""

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, vectors = _matrix(left["q"]), _matrix(right["v"])
        query_ids, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        bounds = left["bound"].to_pylist() if bounded else [None] * len(queries)
        found_ids, found_scores = [], []
        all_scores = scores(queries, vectors)
        for query_id, bound, row in zip(query_ids, bounds, all_scores, strict=True):
            fit = ids != query_id
            if bound is not None:
                fit &= row >= bound
            at = np.flatnonzero(fit)
            if len(at) > k:
                least = np.partition(row[at], len(at) - k)[len(at) - k]
                at = at[row[at] >= least]
            order = sorted(at.tolist(), key=lambda i: (-int(row[i]), int(ids[i])))[:k]
            found_ids.append([int(ids[i]) for i in order])
            found_scores.append([int(row[i]) for i in order])
        keep = [i for i, x in enumerate(found_ids) if x] if bounded else list(range(len(found_ids)))
        rows = left.take(pa.array(keep, pa.int64())) if len(keep) < len(found_ids) else left
        return pa.table({
            "row": rows["row"].cast(pa.int64()), "ids": pa.array([found_ids[i] for i in keep], pa.list_(pa.int64())),
            "scores": pa.array([found_scores[i] for i in keep], pa.list_(pa.int64())),
        })

    return solve


def knn_join(
    vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", vec_id: str = "vec_id",
    pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK, scale: int = SCALE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds, the k other vectors of the
    largest integer inner products, ties to the smaller id; all, if there are fewer.

    Rows with a null id, or a vector that is null or holds null or non-finite components, take no part.
    Shorter vectors count as filled with zeros. A row never finds rows of its own id; other rows that
    repeat an id are separate, as queries too. Products beyond a long stop at its limits. Further columns
    are not read. Empty input: no rows. To the driver go the pivots and a row per group.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantized(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where("vec_id is not null and v is not null")
    wide = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(wide) - F.size("v"))))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(4 * pivots).collect()
    different = list(dict.fromkeys(tuple(r.v) for r in drawn))[:pivots]
    centers = np.array(different, np.float64).reshape(len(different), wide)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v")).reshape(batch.num_rows, wide)
                cell, distance = _nearest(x, centers)
                norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), batch.column("query"), pa.array(cell.astype(np.int32)), pa.array(distance), pa.array(norm)],
                    ["vec_id", "v", "query", "cell", "distance", "norm"],
                )

    dealt = rows.mapInArrow(assign, "vec_id long, v array<long>, query boolean, cell int, distance double, norm double")
    dealt = stored(dealt.withColumn("row", F.monotonically_increasing_id()), "cells")
    n = max(len(centers), 1)
    count, asked, radius, norm = [0] * n, [0] * n, [0.0] * n, [0.0] * n
    for r in dealt.groupBy("cell").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("query"), 1)).alias("q"), F.max("distance").alias("r"), F.max("norm").alias("m")
    ).collect():
        count[r.cell], asked[r.cell], radius[r.cell], norm[r.cell] = r.n, r.q, r.r, r.m
    n_blocks = [max(1, -(-c // block)) for c in count]

    # First, each query meets the block of its own group that its row would be in.
    data = dealt.select("vec_id", "v", "cell", F.pmod(F.xxhash64("row"), _pick(n_blocks, "cell")).alias("block"))
    queries = dealt.where("query").select(
        "row", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "cell", F.pmod(F.xxhash64("row"), _pick(n_blocks, "cell")).alias("block"))
    parts = [max(1, -(-a // (query_block * b))) for a, b in zip(asked, n_blocks, strict=True)]
    own = _meet(queries, data, parts, _solve(k, False))
    bound = F.when(F.size("scores") >= k, F.element_at("scores", -1))
    own = stored(own.select("row", "ids", "scores", bound.alias("bound")), "own")

    # Then it goes where its bound can be reached. A bound is widened by more than rounding can err.
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("q")).reshape(batch.num_rows, wide).astype(np.float64)
            size = np.sqrt((q * q).sum(1))[:, None]
            most = np.minimum(q @ centers.T + size * np.array(radius), size * np.array(norm))
            most += 1 + 1e-9 * size * (np.array(norm) + np.array(radius))
            bounds = np.array([-np.inf if b is None else b for b in batch.column("bound").to_pylist()])[:, None]
            at, cells = np.nonzero(~(most < bounds) & (np.array(count) > 0))
            for i in range(0, len(at), 8192):
                part = batch.select(["row", "query_id", "q", "bound", "home", "home_block"]).take(pa.array(at[i : i + 8192]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[i : i + 8192].astype(np.int32))], [*part.schema.names, "cell"])

    bounded = queries.withColumnsRenamed({"cell": "home", "block": "home_block"}).join(own.select("row", "bound"), "row")
    sent = stored(bounded.mapInArrow(reach, "row long, query_id long, q array<long>, bound long, home int, home_block long, cell int"), "sent")
    needing = [0] * n
    for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect():
        needing[r.cell] = r.n
    parts = [max(1, -(-a // query_block)) for a in needing]
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), _pick(n_blocks, "cell").cast("long") - 1)))
    sent = sent.where(~((F.col("cell") == F.col("home")) & (F.col("block") == F.col("home_block")))).drop("home", "home_block")
    others = _meet(sent, data, parts, _solve(k, True))

    every = own.select("row", "ids", "scores").unionByName(others)
    every = every.select("row", F.inline(F.arrays_zip("ids", "scores"))).toDF("row", "vec_id", "score")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(queries.select("row", "query_id"), "row").select("query_id", "rank", "vec_id", "score")


def _meet(queries: DataFrame, data: DataFrame, parts: list[int], solve) -> DataFrame:
    """Queries and vectors of the same block, the queries of a block in ``parts`` by its group."""
    queries = queries.withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), _pick(parts, "cell")))
    data = data.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), _pick(parts, "cell").cast("long") - 1)))
    keys = ["cell", "block", "part"]
    return queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(solve, "row long, ids array<long>, scores array<long>")
