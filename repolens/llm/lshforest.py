"""Near duplicates by a MinHash LSH forest, confirmed on full shingle sets.

The forest has several orders; in each, sets are sorted by a signature of their own, a sequence of min-hashes,
and sets with a long common prefix are neighbours. A region of an order is a run with the same prefix. Its
depth adapts: a region that would still make too many comparisons is cut one step deeper, and its sets enter
more orders there, as many as it takes to miss a pair at the threshold with a probability below ``MISS``. What
is crowded at the greatest depth is compared whole. So no candidate is dropped for the size of its region.

Within a region, each set is first compared with a first neighbour. Regions whose sets are of one component
then need nothing more; in others, only sets of different components are compared. Two exact bounds go before
full sets are fetched: the sizes, and the parity of the shingles that fall on each of 1,024 bits, which no
common shingle changes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import stored, text_bytes
from repolens.llm.components import components
from repolens.llm.simhash import _shingle_hashes as shingle_hashes

SHINGLE_WORDS, PERCENT = 3, 85
#: Prefix lengths of the forest, and the probability to miss a pair at the threshold at each of them.
DEPTHS, MISS = (2, 4, 8), 1e-6
#: Comparisons of a region per set in it, from which it is cut deeper; sets that share a first neighbour.
CROWD, FIRST = 256, 1024
SKETCH = 16
#: A bitmap has room for 2^15 node ids, those that are alike but for so many last bits.
_BITS = 15
#: Documents a task looks at, shingles it hands on at once, and sets whose copies it remembers.
_SLICE, _CHUNK, _KNOWN = 256, 1 << 18, 50_000
_NODE = "row long, doc_id {id}, n long, key binary, hashes array<long>, sketch array<long>, regions array<long>"


def orders_for(depth: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Orders of which at least one keeps a pair at the threshold together, but for ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** depth))) if percent < 100 else 1


def _mixers(orders: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Constants of the hash functions; order t has the same first functions at every depth."""
    at = [xxhash.xxh64_intdigest(f"{t}.{d}.{s}") for t in range(orders) for d in range(depth) for s in "ab"]
    pairs = np.array(at, np.uint64).reshape(-1, 2)
    return pairs[:, 0] | np.uint64(1), pairs[:, 1]


def regions_of(hashes: np.ndarray, orders: int, depth: int, mixers: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """The region of a set in each order, as a hash of order, depth and common prefix."""
    least = np.full(orders * depth, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        mixed = (hashes[at : at + 2048] ^ mixers[1][:, None]) * mixers[0][:, None]
        np.minimum(least, mixed.min(1), out=least)
    rows = least.reshape(orders, depth)
    return [int(np.int64(np.uint64(xxhash.xxh64_intdigest(rows[t].tobytes(), t + (depth << 16))))) for t in range(orders)]


def _sketch(hashes: np.ndarray) -> np.ndarray:
    bits = np.bincount((hashes & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(docs: DataFrame, id_type: str, words: int, percent: int) -> DataFrame:
    """A row per document with its set; later copies of a set in a task come without it."""
    depth = DEPTHS[0]
    orders = orders_for(depth, percent)
    mixers = _mixers(orders, depth)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in (b.slice(at, _SLICE) for b in batches for at in range(0, b.num_rows, _SLICE)):
            names, held = [], 0
            rows: list[tuple] = []

            def out(batch=batch, rows=rows, names=names) -> pa.RecordBatch:
                at = pa.array(names, pa.int64())
                cols = list(zip(*rows, strict=True))
                long_list = pa.list_(pa.int64())
                return pa.RecordBatch.from_arrays(
                    [batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), *(pa.array(c, long_list) for c in cols[2:])],
                    ["row", "doc_id", "n", "key", "hashes", "sketch", "regions"],
                )

            for i, data in enumerate(text_bytes(batch.column("text"))):
                found = [h for h in shingle_hashes(data, words)]
                hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
                key = xxhash.xxh3_128_digest(hashes.tobytes()) + len(hashes).to_bytes(8, "big") if len(hashes) else None
                names.append(i)
                if key is None or key in known:
                    rows.append((len(hashes), key, None, None, None))
                else:
                    if len(known) >= _KNOWN:
                        known.clear()
                    known.add(key)
                    rows.append((len(hashes), key, hashes.view(np.int64), _sketch(hashes), regions_of(hashes, orders, depth, mixers)))
                    held += len(hashes)
                if held >= _CHUNK:
                    yield out()
                    rows.clear()
                    names.clear()
                    held = 0
            if rows:
                yield out()
        # The worker stays for later tasks; what it held goes back to the machine.
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(build, _NODE.format(id=id_type))


def _deeper(sets: DataFrame, orders: int, depth: int) -> DataFrame:
    """``region, node`` of the sets in all orders at a greater depth."""
    mixers = _mixers(orders, depth)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regions = [regions_of(np.array(h, np.int64).view(np.uint64), orders, depth, mixers) for h in batch.column("hashes").to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(regions, pa.list_(pa.int64()))], ["node", "regions"])

    cut_rows = sets.select("node", "hashes").mapInArrow(cut, "node long, regions array<long>")
    return cut_rows.select(F.explode("regions").alias("region"), "node")


def _near(percent: int) -> Column:
    """Whether sizes ``n_a, n_b`` and sketches ``s_a, s_b`` leave a pair; exact bounds, both."""
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    # Of two sets at the threshold, (100 + t) |A xor B| is (100 - t) (|A| + |B|).
    return sizes & ((100 + percent) * _apart() <= (100 - percent) * (F.col("n_a") + F.col("n_b")))


def _apart() -> Column:
    bits = [F.bit_count(F.col("s_a")[i].bitwiseXOR(F.col("s_b")[i])) for i in range(SKETCH)]
    return sum(bits, F.lit(0).cast("long"))


def _side(nodes: DataFrame, x: str) -> DataFrame:
    return nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))


def _only(table: DataFrame, picked: DataFrame) -> DataFrame:
    """The rows of ``table`` with a ``node`` of ``picked``, where they lie. Ids count the rows of a task, so a bitmap of
    them takes about a bit for each document; it is sent to all, and the wide rows are not moved."""
    of, bit = F.shiftright("node", _BITS), F.col("node").bitwiseAND((1 << _BITS) - 1)
    maps = picked.groupBy(of.alias("_of")).agg(F.bitmap_construct_agg(bit).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = table.join(F.broadcast(maps), of == F.col("_of"))
    return met.where(F.getbit(byte, bit % 8) == 1).select(*table.columns)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def _nearest(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of ``a, b``, one pair the bounds leave for each b: that of the most similar sketches."""
    pairs = stored(pairs, "first")
    ends = stored(_only(nodes.select("node", "n", "sketch"), _ends(pairs)), "ends")
    left = pairs.join(_side(ends, "a"), "a").join(_side(ends, "b"), "b").where(_near(percent))
    return left.groupBy("b").agg(F.min(F.struct(_apart().alias("apart"), "a"))["a"].alias("a"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``a, b``, the pairs whose full sets are similar enough. Only the sets in question are moved."""
    needed = stored(_only(sets.select("node", "n", "hashes"), _ends(pairs)), "needed")
    ends = lambda x: needed.join(pairs.select(F.col(x).alias("node")), "node", "left_semi")
    side = lambda x: ends(x).select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("hashes").alias(f"h_{x}"))
    both = F.size(F.array_intersect("h_a", "h_b")).cast("long")
    link = 100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)
    return pairs.join(side("b"), "b").join(side("a"), "a").where(link).select("a", "b")


def _shared(members: DataFrame) -> DataFrame:
    """``region, node, total, top`` of the regions with more than one set; most have one only, and their rows
    are moved no further."""
    many = members.groupBy("region").agg(F.count("*").alias("total"), F.min("node").alias("top")).where("total > 1")
    return stored(members.join(stored(many, "many"), "region"), "members")


def _first_neighbours(members: DataFrame) -> DataFrame:
    """``a, b``: in each region, sets with the first of about ``FIRST`` of them, and these with the first of all."""
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("total") / FIRST))
    dealt = members.select("region", "top", "node", part.alias("part"))
    heads = dealt.groupBy("region", "part").agg(F.min("node").alias("head"), F.first("top").alias("top"))
    near = dealt.join(heads.select("region", "part", "head"), ["region", "part"]).select(F.col("head").alias("a"), F.col("node").alias("b"))
    return near.unionByName(heads.select(F.col("top").alias("a"), F.col("head").alias("b"))).where("a < b").distinct()


def _crossing(members: DataFrame, roots: DataFrame, nodes: DataFrame, crowd: int | None, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of a region's sets in different components that the bounds leave, and ``node`` of those in regions
    too crowded for it.

    Sets outside the region's largest component meet all others, so the comparisons are at most twice the
    pairs that cross components.
    """
    placed = members.select("region", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    shares = placed.groupBy("region", "root").agg(F.count("*").alias("c"))
    regions = shares.groupBy("region").agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.col("c")).alias("square"), F.max(F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    crowded = F.lit(False) if crowd is None else (F.col("total") * F.col("total") - F.col("square")) > 2 * crowd * F.col("total")
    open_ = stored(placed.join(regions.select("region", F.col("main.root").alias("main"), crowded.alias("crowded")), "region"), "open")
    fit = open_.where("not crowded")
    ends = stored(_only(nodes.select("node", "n", "sketch"), fit.select("node")), "ends")
    others = fit.where("root <> main").select("region", F.col("node").alias("b"), F.col("root").alias("root_b")).join(_side(ends, "b"), "b")
    every = fit.select("region", F.col("node").alias("a"), "root").join(_side(ends, "a"), "a")
    met = every.join(others, "region").where((F.col("root") != F.col("root_b")) & _near(percent))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs, open_.where("crowded").select("node").distinct()


def similar_groups(
    docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id", crowd: int = CROWD
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document.

    Texts are lower-cased in A-Z; a set holds a text's distinct shingles of ``words`` words, as 64-bit hashes;
    a shorter text is one shingle. Documents are linked if ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest doc_id reachable. Null and empty texts, and texts without words, are linked
    with nothing. Equal sets are one node. A null doc_id is linked like any other and never is a component's id,
    unless the component has no other. Repeated rows give repeated rows. Further columns are not read. Empty
    input: no rows. Every stage is a written table.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent")
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = named.schema["doc_id"].dataType.simpleString()
    rows = stored(_sets(named, id_type, words, percent), "sets")
    owners = rows.where("key is not null").groupBy("key").agg(F.min(F.when(F.col("sketch").isNotNull(), F.col("row"))).alias("node"), F.min("doc_id").alias("least_id"))
    owners = stored(owners, "owners")
    # Several tasks may have the same set; only one of its rows is a node, and pairs are pairs of nodes.
    sets = rows.where("sketch is not null").withColumnRenamed("row", "node")
    nodes = stored(_only(sets.select("node", "n", "sketch", "regions"), owners.select("node")), "nodes")
    members = nodes.select(F.explode("regions").alias("region"), "node")
    links = None
    for depth in DEPTHS:
        members = _shared(members)
        # One neighbour each is enough to tell most of a group of near copies.
        first = stored(_nearest(_first_neighbours(members), nodes, percent), "neighbours")
        found = _confirmed(first, sets, percent)
        roots = components(found if links is None else links.unionByName(found))
        crossing, crowded = _crossing(members, roots, nodes, None if depth == DEPTHS[-1] else crowd, percent)
        found = stored(_confirmed(stored(crossing, "crossing"), sets, percent), "links")
        # What is known of components is a star of each.
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
        crowded = stored(crowded, "crowded")
        if depth == DEPTHS[-1] or crowded.isEmpty():
            break
        deeper = DEPTHS[DEPTHS.index(depth) + 1]
        members = stored(_deeper(_only(sets, crowded), orders_for(deeper, percent), deeper), "deeper")
    if not found.isEmpty():
        roots = components(links)
    grouped = owners.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    grouped = grouped.join(least, "root").select("key", "component_id")
    linked = rows.where("key is not null").select("doc_id", "n", "key").join(grouped, "key").select("doc_id", "n", "component_id")
    alone = rows.where("key is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("n", "n_shingles")
