"""Ball k-means codes, LSH forest and spelling variants against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolens.llm import ballmeans, lshforest, spelling

from .conftest import edge_rows, prose


# Codes of vectors


def brute_codes(rows, parts, entries, rounds, scale):
    """``rows`` are (vec_id, vector, label); entries compared one by one, in Python's integers."""
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [min(max(math.floor(x * scale), -(1 << 63)), (1 << 63) - 1) for x in vector], label))
    width = max(-(-max((len(v) for _, v, _ in kept), default=0) // parts), 1)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted((i, v) for i, v, _ in kept)[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((square(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, xs in members.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = [], Counter()
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = min(sum(d for d, _ in found), (1 << 63) - 1)
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((i, c, e, min(by_label[label], (1 << 63) - 1), digest) for i, c, e, label in out)


def coded(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("x"))
    found = ballmeans.compress(df.repartition(3), **more)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_codes_are_those_of_comparing_all(spark, rng, spread):
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, spread) for x in centres[i % 6]], i % 3 if i % 5 else None) for i in range(300)]
    assert coded(spark, rows, parts=4, entries=16) == brute_codes(rows, 4, 16, 2, 256)


def test_codes_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (5, [1.0, 2.0, 3.0], 1), (5, [1.0, 2.0, 3.0], 1), (5, [0.5, -2.0], None), (1, [0.0, 0.0, 0.0, 0.0, 0.0], 1), (2, None, 1), (3, [1.0, None], 2),
        (4, [inf, 1.0], 2), (6, [nan], 2), (None, [1.0], 2), (7, [], None), (8, [1e300, -1e300], 3), (9, [3e15, 1.0], 3), (10, [-0.001, 0.001], 3),
    ]
    assert coded(spark, rows, parts=2, entries=3) == brute_codes(rows, 2, 3, 2, 256)
    plain = [r for r in rows if r[0] not in (8, 9)]
    assert coded(spark, plain, parts=2, entries=64) == brute_codes(plain, 2, 64, 2, 256)


def test_codes_without_rows(spark):
    assert coded(spark, [], parts=4) == [] and coded(spark, [(1, None, 2)]) == []


def test_balls_skip_what_cannot_change(rng):
    """Stable cores and rings give the nearest entry of all, with far fewer distances."""
    gen = np.random.default_rng(3)
    book = gen.integers(-1000, 1000, (64, 4))
    x = book[gen.integers(0, 64, 5000)] + gen.integers(-40, 40, (5000, 4))
    moved = book + gen.integers(-15, 15, book.shape)
    own = ballmeans.nearest(x, book)
    radius = [int(max(ballmeans._squares(x[own == e], moved[e]), default=-1)) for e in range(64)]
    at, took = ballmeans.Balls(moved, radius).assign(x, own)
    assert (at == ballmeans.nearest(x, moved)).all()
    assert took < 5000 * 64 / 5


# LSH forest


def shingles(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else ({" ".join(words)} if words else set())


def brute_groups(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    out = [(r[0], len(s), r[0] if not s else min(least[find(i)], default=None)) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]
    return sorted(out, key=repr)


def grouped(df, **more):
    found = lshforest.similar_groups(df, **more)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def family(rng):
    """Texts around the threshold, chains of changes, many near copies and shared passages."""
    rows, base, shared = [], prose(rng, 200).split(), prose(rng, 150)
    rows += [(1000 + i, changed(rng, base, rng.randrange(1, 14))) for i in range(60)]
    step = prose(rng, 150).split()
    for i in range(25):
        step[i * 5] = f"y{i}"
        rows.append((2000 + i, " ".join(step)))
    rows += [(3000 + i, shared + " " + prose(rng, rng.randrange(20, 200))) for i in range(40)]
    rows += [(4000 + i, " ".join(base)) for i in range(30)]
    return rows


@pytest.mark.parametrize("crowd", [lshforest.CROWD, 0])
def test_groups_are_those_of_all_pairs(docs, rng, crowd, monkeypatch):
    """With ``crowd`` 0 every region of several components is cut to the greatest depth and compared whole."""
    monkeypatch.setattr(lshforest, "FIRST", 8)
    rows = family(rng)
    assert grouped(docs(rows), crowd=crowd) == brute_groups(rows)


def test_groups_of_odd_documents(docs, rng):
    rows = [r[:2] for r in edge_rows(rng) if r[0] != 7] + [(20, "A b\tC"), (21, "a B c"), (22, "a b"), (23, "\x85  x y"), (24, prose(rng, 30_000))]
    assert grouped(docs(rows, key="'x'", n="1", row="2", regions="3", node="4")) == brute_groups(rows)


def test_groups_without_rows(docs):
    assert grouped(docs([])) == [] and grouped(docs([(1, None), (2, " ")])) == [(1, 0, 1), (2, 0, 2)]


def test_rows_are_picked_where_they_lie(spark, rng):
    """By ids of several tasks, at the borders of bitmaps too; wide rows cross no shuffle, whatever their size."""
    ids = sorted({(part << 33) + i for part in range(5) for i in [0, 1, 7, 8, 32767, 32768, 65535, *rng.sample(range(100_000), 40)]})
    picked = rng.sample(ids, len(ids) // 2) + [(9 << 33) + 5]
    table = spark.createDataFrame([(i, [i, i + 1]) for i in ids], "node long, hashes array<long>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        only = lshforest._only(table, spark.createDataFrame([(i,) for i in picked + picked], "node long"))
        assert only.columns == table.columns
        assert sorted(tuple(r) for r in only.collect()) == [(i, [i, i + 1]) for i in ids if i in set(picked)]
        assert lshforest._only(table, table.select("node").limit(0)).collect() == []
        plan = only._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.split("\n") if "hashpartitioning(node" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_forest_moves_no_wide_rows_but_those_confirmed(docs, rng, monkeypatch):
    """With broadcasts of Spark's choice off, sets and sketches are picked where they lie."""
    shuffled, kept = [], lshforest.stored

    def watched(df, name):
        if name in ("nodes", "ends", "needed"):
            plan = df._jdf.queryExecution().executedPlan().toString()
            shuffled.extend(line for line in plan.split("\n") if "hashpartitioning(node" in line)
        return kept(df, name)

    monkeypatch.setattr(lshforest, "stored", watched)
    rows = family(rng)[:80]
    frame = docs(rows)
    spark = frame.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert grouped(frame) == brute_groups(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not shuffled


def test_components_stop_at_stars(spark, monkeypatch):
    """Edges that are stars already need no round; others end as stars on the smallest node."""
    from repolens.llm import components as module

    rounds, kept = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: rounds.append(name) or kept(df, name))
    stars = spark.createDataFrame([(5, 1), (1, 7), (9, 8), (9, 8), (4, 4), (None, 3)], "a long, b long")
    assert sorted(map(tuple, module.components(stars).collect())) == [(5, 1), (7, 1), (9, 8)]
    assert rounds == ["edges"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (41, 50)], "a long, b long")
    assert sorted(map(tuple, module.components(chain).collect())) == [(i, 0) for i in range(1, 31)] + [(41, 40), (50, 40)]


def test_forest_misses_hardly_a_pair_at_the_threshold():
    gen = np.random.default_rng(1)
    for depth in lshforest.DEPTHS:
        orders = lshforest.orders_for(depth)
        assert (1 - 0.85**depth) ** orders <= lshforest.MISS
        mixers, met = lshforest._mixers(orders, depth), 0
        for _ in range(40):
            pool = gen.integers(0, 1 << 63, 107).astype(np.uint64)
            a, b = (lshforest.regions_of(x, orders, depth, mixers) for x in (pool[:99], pool[8:]))  # 91 of 107
            met += sum(x == y for x, y in zip(a, b, strict=True))
        assert abs(met / (40 * orders) - 0.85**depth) < 0.08


def test_sketch_bounds_the_difference():
    gen = np.random.default_rng(2)
    for _ in range(50):
        pool = np.unique(gen.integers(0, 1 << 63, 2000).astype(np.uint64))
        a, b = pool[: gen.integers(1, 1500)], pool[gen.integers(0, 900) :]
        apart = sum(int(x ^ y).bit_count() for x, y in zip(lshforest._sketch(a).view(np.uint64), lshforest._sketch(b).view(np.uint64), strict=True))
        assert apart <= len(np.setxor1d(a, b))


# Spelling variants


def letters(c):
    return "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ"


def brute_words(rows, noise=31):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if letters(c):
                run += c.lower() if c < "\x80" else c
                continue
            word, run = run, ""
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if word and noise and h % noise == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(((-counts[v], v.encode(), v) for v in vs), default=None)
        form[w] = best[2] if best and -best[0] >= 10 * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


def test_variants_are_those_of_all_pairs(docs, rng):
    alphabet, words = "abcdeéÿ", []
    for _ in range(60):
        word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(7, 13)))
        words += [word] * rng.choice([2, 3, 30, 400])
        for _ in range(6):
            at, c = rng.randrange(len(word)), rng.choice(alphabet)
            words += [rng.choice([word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :]])] * rng.choice([1, 2, 3, 40])
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"] * 3 + ["ABCDÉFGH", "abcdéfgh", "abcdÉfgh"] * 2 + ["x" * 500, "x" * 499] * 2
    rng.shuffle(words)
    rows = [(i if i else None, " ".join(words[i * 50 : i * 50 + 50])) for i in range(len(words) // 50 + 1)]
    found = spelling.corpus_variants(docs(rows, word="'w'", n="3"))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == brute_variants(brute_words(rows))
    assert any(r[1] for r in got) and any(r[2] != (r[1] or r[0]) for r in got)


def test_words_of_odd_documents(docs, rng, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD", 5)
    rows = [r[:2] for r in edge_rows(rng) if r[0] != 7] + [(30, "Straße×÷ÀÿZz1abcdefg abcdefg_ABCDEFG Ünïcödé " * 40), (31, "x" * 3_000_000), (31, "x" * 3_000_000)]
    got = {r.word: r.n for r in spelling.word_counts(docs(rows)).where("n >= 2").collect()}
    assert got == brute_words(rows)


def test_words_without_rows(docs):
    assert spelling.corpus_variants(docs([])).count() == 0 and spelling.corpus_variants(docs([(1, None), (2, "a b")])).count() == 0


def test_chain_of_forms_leads_to_its_end(spark):
    words = [("aaaabbbb", 2), ("aaaabbbc", 20), ("aaaabbcc", 200), ("aaaabccc", 2000), ("aaaacccc", 20000), ("zzzzzzzz", 5)]
    got = spelling.spelling_variants(spark.createDataFrame(words, "word string, n long")).collect()
    assert {r.word: r.root for r in got} == {w: "aaaacccc" if w[0] == "a" else w for w, _ in words}
