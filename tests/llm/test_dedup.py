"""SimHash, exact and line deduplication, and components, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from repolens.llm import gracehash, linespread, simhash
from repolens.llm.common import blocks
from repolens.llm.components import components

from .conftest import edge_rows, prose


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_blocks_cut_no_word(size, rng):
    for text in ("", "a", " a  bb\n", prose(rng, 50), "x" * 30 + " y", "  "):
        raw = text.encode()
        parts = list(blocks(raw, size))
        assert b"".join(parts) == raw
        assert [w for p in parts for w in p.split()] == raw.split()


def test_fingerprint(rng):
    for text in ("", " \n", "One", "a B", "ab cd ef", "É é \x1c x", "A\vb\fc\rd", prose(rng, 500)):
        assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == slow_fingerprint(text)


def test_native_hash_is_the_same(spark):
    """Seed 42 and UTF-8 are what Spark's own function uses, too."""
    got = spark.range(1).select(F.xxhash64(F.lit("é b c"))).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest("é b c".encode(), 42)


def test_near_pairs_are_all_pairs(spark, rng):
    """Random points and dense clouds around some, also with bits of one segment and of the sign."""
    points = {rng.getrandbits(64) for _ in range(300)}
    for center in list(points)[:20] + [0, (1 << 64) - 1]:
        points.add(center)
        for _ in range(25):
            x = center
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
            points.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in points]
    want = {(a, b) if a < b else (b, a) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    rows = simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert Counter(tuple(sorted(r)) for r in rows) == Counter(want)
    with pytest.raises(ValueError):
        simhash.near_pairs(spark.range(1).withColumnRenamed("id", "fp"), 4)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, rng, shape):
    edges = {
        "chain": [(i, i + 1) for i in range(60)], "star": [(1000, i) for i in range(100)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)], "none": [],
    }[shape]
    df = spark.createDataFrame(edges + [(5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    nodes = {x for e in edges for x in e}
    want = {n: r for n, r in slow_roots(nodes, [e for e in edges if e[0] != e[1]]).items() if n != r}
    assert got == want


def test_simhash_groups(spark, docs, rng):
    base = prose(rng, 200).split()
    rows = edge_rows(rng) + [(100 + i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(0, 200, 10)]
    got = simhash.simhash_groups(docs(rows, fp="1", component_id="2", root="'x'")).collect()
    prints = [slow_fingerprint(r[1]) if r[0] != 7 else simhash.fingerprint(r[1].encode()) & (1 << 64) - 1 for r in rows]
    ids = defaultdict(list)
    for r, p in zip(rows, prints, strict=True):
        ids[p].append(r[0])
    linked = [(a, b) for a in ids for b in ids if a < b and (a ^ b).bit_count() <= 3]
    roots = slow_roots(ids, linked)
    least = {}
    for p, r in roots.items():
        least[r] = min((i for q in ids if roots[q] == r for i in ids[q] if i is not None), default=None)
    want = Counter((r[0], p, least[roots[p]]) for r, p in zip(rows, prints, strict=True))
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    kept = simhash.keep_one_of_each(docs(rows, n_extra="3", drop_id="'clash'"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_extra", "drop_id"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_simhash_of_nothing(docs):
    assert simhash.simhash_groups(docs([(1, "x")]).limit(0)).collect() == []
    assert simhash.keep_one_of_each(docs([(1, "x")]).limit(0)).collect() == []


def test_normalized(rng):
    for text in ("", " ", "a", " a\t\n b ", "a\x0b\x0cb", "a\x1cb", "  " * 700_000 + "x", prose(rng, 300_000).replace(" ", " \n")):
        assert gracehash.normalized(text.encode()) == re.sub(rb"[\x20\x09-\x0D]+", b" ", text.encode())


def test_equal_hashes_of_different_contents():
    table = gracehash.ContentTable(4)
    assert [table.add(7, x) for x in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1]
    assert [table.add(h, b"%d" % h) for h in range(100)] == list(range(3, 103))
    assert [table.add(h, b"%d" % h) for h in range(100)] == list(range(3, 103))


def slow_groups(rows):
    groups = defaultdict(list)
    for i, (doc_id, text, *_) in enumerate(rows):
        groups[re.sub(rb"[\x20\x09-\x0D]+", b" ", (text or "").encode())].append((doc_id is None, doc_id or 0, i))
    out = []
    for content, members in groups.items():
        keep = min(members)
        for m in members:
            out.append((None if m[0] else m[1], None if keep[0] else keep[1], len(members), m == keep, hashlib.sha256(content).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("table_bytes", [1 << 26, 3000, 1])
def test_exact_groups(docs, rng, table_bytes):
    """Also with tables so small that each bucket is partitioned down to single hashes."""
    texts = [prose(rng, 12) for _ in range(30)]
    rows = edge_rows(rng) + [(200 + i, rng.choice(texts)) for i in range(150)]
    df = docs(rows, sha="1", hash="2", rid="3").repartition(3)
    got = gracehash.exact_groups(df, table_bytes=table_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == slow_groups(rows)
    assert gracehash.exact_groups(df.limit(0)).collect() == []


def test_spread_lines_leave_but_once(docs):
    common, rare, short = "share this page with friends", "a line on only four sites", "menu"
    rows = [(i, f"own line of number {i} here\n  {common}\t\n{rare if i < 4 else 'x'}\n{short}\n \n", "en", f"s{i}") for i in range(6)]
    rows += [(20, f"{common}\n{common}", "en", "s1"), (21, None, "en", "s2"), (22, "", "en", None), (23, common, "en", None), (23, common, "en", None), (None, common, "en", "s9")]
    cleaned = linespread.dedup_lines(docs(rows, gone_id="1", n_lines="9"))
    assert cleaned.columns == ["doc_id", "text", "lang", "source", "n_chars", "gone_id", "n_lines", "_n_lines", "n_removed"]
    got = Counter((r.doc_id, r.text, r._n_lines, r.n_removed) for r in cleaned.collect())
    want = [(0, rows[0][1], 6, 0)]
    want += [(i, f"own line of number {i} here\n{rare if i < 4 else 'x'}\n \n", 6, 2) for i in range(1, 6)]
    want += [(20, "", 2, 2), (21, None, 0, 0), (22, "", 1, 0), (23, "", 1, 1), (23, "", 1, 1), (None, "", 1, 1)]
    assert got == Counter(want)
    assert linespread.dedup_lines(docs(rows).limit(0)).collect() == []


def test_sites_are_exact_near_the_threshold(spark, rng):
    """Thousands of sites: the sketch errs, the counts near the threshold do not."""
    rows = [(line, 0, f"site{s}") for line, n in enumerate(range(1900, 2101, 10)) for s in range(n) for _ in range(1 + s % 2)]
    lines = spark.createDataFrame(rows, "k1 long, k2 long, site string").withColumn("place", F.lit(1))
    got = {r.k1 for r in linespread.spread_lines(lines, min_sites=2000).collect()}
    assert got == {line for line, n in enumerate(range(1900, 2101, 10)) if n >= 2000}


def test_runs_of_lines_that_stay(spark):
    for n, gone in ((5, [0, 4]), (5, [1, 2]), (1, [0]), (4, [0, 1, 2, 3]), (3, [1])):
        row = spark.createDataFrame([(list(map(str, range(n))), gone)], "p array<string>, g array<int>")
        got = row.select(linespread._without(F.col("p"), F.col("g"))).first()[0]
        assert got == [str(i) for i in range(n) if i not in gone]


