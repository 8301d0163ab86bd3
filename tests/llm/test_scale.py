"""Mixing, packing, license scans and search against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repolens.llm import licenses, mixing, packing, voronoi

from .conftest import edge_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    """Fill by weight, and share again what is above, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: float(most * sizes[s]) for s in full}
        target |= {s: rest / (sum(weight[s] for s in open_) or 1) * weight[s] for s in open_}
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("buckets", [4096, 3])
def test_mix(spark, docs, rng, buckets):
    names = ["b", "a", "ä", "Z", "", None, "big", "e1", "e2"]
    sizes = [3, 3, 2, 2, 1, 2, 300, 2, 2]
    rows = [(i, prose(rng, rng.choice((0, 5, 60, 200))) + " &&&" * rng.choice((0, 20)), "en", rng.choices(names, sizes)[0]) for i in range(400)]
    rows += edge_rows(rng)[:6] + edge_rows(rng)[9:] + [(500, prose(rng, 3000), "en", "a")]
    df = docs(rows, size="'x'", target="1").repartition(3)
    got = mixing.mix(df, buckets=buckets).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    source_sizes = defaultdict(int)
    for r in rows:
        source_sizes[r[3]] += len(WORD.findall(r[1] or ""))
    targets, taken = slow_targets(source_sizes), defaultdict(int)
    for r in got:
        assert r.source_size == source_sizes[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert math.floor(t) - 3 <= taken[s] <= t  # repeated rows share a remainder
    # Epochs: of one source, no document is taken a whole time more than another's whole times plus one.
    for s in targets:
        times = [r.taken / r.size for r in got if r.source == s and r.size]
        assert not times or max(times) - min(times) <= 1
    again = mixing.mix(df.repartition(7), buckets=buckets).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    copies = Counter((r.doc_id, r.text) for r in mixing.mixed_documents(df, buckets=buckets).collect())
    words = defaultdict(int)
    for (doc_id, text), n in copies.items():
        words[next(r[3] for r in rows if r[0] == doc_id and r[1] == text)] += n * len(WORD.findall(text))
    for s, t in targets.items():
        longest = max((len(WORD.findall(r[1] or "")) for r in rows if r[3] == s), default=0)
        assert abs(words[s] - t) <= 1.5 * longest + 1


def test_mix_prefers_quality(spark, docs, rng):
    rows = [(i, prose(rng, 50) if i % 2 else "### " * 50, "en", "s") for i in range(2000)] + [(9999, prose(rng, 100_000), "en", "t")]
    got = mixing.mix(docs(rows), weights=(1, 8), max_epochs=3).where("source = 's'").collect()
    extra = Counter(r.doc_id % 2 for r in got if r.taken > min(x.taken for x in got))
    assert extra[1] > 1.5 * extra[0]


def test_mix_of_nothing(docs):
    assert mixing.mix(docs([(1, "x")]).limit(0)).collect() == []
    assert [r.taken for r in mixing.mix(docs([(1, None), (2, "  ")])).collect()] == [0, 0]


def test_assign_fills_exactly(rng):
    for lengths in ([], [1], [2048], [2049], [0, 3], [5000, 1, 1, 700], [rng.randint(1, 3000) for _ in range(300)]):
        used, seen = Counter(), defaultdict(list)
        rooms = packing.rooms(sum(lengths))
        for doc, start, n, seq, offset in packing.assign(lengths):
            assert offset == used[seq]
            used[seq] += n
            seen[doc].append((start, n))
        assert [used[i] for i in range(len(rooms))] == rooms
        for doc, n in enumerate(lengths):
            assert [i for s, m in sorted(seen[doc]) for i in range(s, s + m)] == list(range(n))
        assert all(n == 2048 or n & (n - 1) == 0 for n in rooms)


def test_costs_are_balanced(rng):
    lengths = [rng.randint(10, 1500) for _ in range(2000)]
    costs = Counter()
    for _, _, n, seq, _ in packing.assign(lengths):
        costs[seq] += packing.cost(n)
    full = [costs[i] for i, room in enumerate(packing.rooms(sum(lengths))) if room == 2048]
    assert np.std(full) < 0.1 * np.mean(full)


def test_words_can_be_remembered(rng):
    path = public_tokenizers.path(packing.TOKENIZER)
    plain, own = Tokenizer.from_file(path), packing.WordTokenizer(path, words=50, parts=40)
    texts = ["", "A b", "it's  HE'LL\n\n12a ++x é́ é  x y \x1c ẞ", "<|endoftext|> a<|startoftext|>b", "日本 語ab", prose(rng, 300), "a ́b",
             "T̈. İ! İ, Ǆ? É. é.. ÷. ×! x<|endoftext|>. <|ENDOFTEXT|> a'. it's. 'S, don't! a1. _b_ `c` ǰ J̌, ﬁ. ™. a™. ª."]
    for text in texts:
        assert own.ids(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids
    alphabet = "aBz é É ñ ̈ 1 . , ' ! - % <| |> s t ll T İ ß ™ 日 \n \u00a0 × re".split(" ")
    for _ in range(3000):
        text = "".join(rng.choice([*alphabet, " "]) for _ in range(rng.randint(1, 12)))
        assert own.ids(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_new_words_are_encoded_together(rng):
    """Plain words of a text go to the tokenizer many at a time, and each word has the ids it has alone."""
    path = public_tokenizers.path(packing.TOKENIZER)
    plain, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    calls = []

    class Spy:
        def encode_batch_fast(self, texts, **more):
            calls.extend(texts)
            return plain.encode_batch_fast(texts, **more)

    own._tokenizer = Spy()
    words = ["".join(rng.choice("abcdeéßÄOU") for _ in range(rng.randint(4, 9))) + rng.choice(["", "", ".", ",", "!?"]) for _ in range(20_000)]
    texts = [" ".join(words[at : at + 500]) for at in range(0, len(words), 500)]
    got = own.ids_of([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) < 100
    # Where the ends of words cannot be told, each word is encoded alone.
    other = packing.WordTokenizer(path)
    other._ends[:] = False
    assert other.ids(texts[0].encode()).tolist() == got[0].tolist()


def test_calls_of_the_tokenizer_are_bounded(rng):
    """However many new words a text has, the tokenizer gets some of them at a time."""
    path = public_tokenizers.path(packing.TOKENIZER)
    plain, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    sizes = []

    class Spy:
        def encode_batch_fast(self, texts, **more):
            sizes.append((len(texts), sum(len(t.encode()) for t in texts)))
            return plain.encode_batch_fast(texts, **more)

    own._tokenizer = Spy()
    words = ["".join(rng.choice("abcde") for _ in range(9)) for _ in range(90_000)] + [f"{i}x{i}" for i in range(9000)]
    text = " ".join(words)
    assert own.ids(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(sizes) > 4 and max(n for n, _ in sizes) <= 4096 and max(size for _, size in sizes) < 300_000


@pytest.mark.parametrize("group_tokens", [1 << 20, 3000])
def test_packed(spark, docs, rng, group_tokens):
    path = public_tokenizers.path(packing.TOKENIZER)
    rows = [r for r in edge_rows(rng) if r[0] != 7] + [(7, prose(rng, 9000)), *[(50 + i, prose(rng, rng.randint(1, 900))) for i in range(40)]]
    df = docs(rows, ids="'x'", length="1").repartition(2)
    got = packing.packed(df, path, group_tokens=group_tokens).collect()
    plain = Tokenizer.from_file(path)
    want, seen = Counter(), defaultdict(list)
    for r in rows:
        want[r[0], tuple(plain.encode(r[1] or "", add_special_tokens=False).ids) + (1,)] += 1
    sequences = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        seen[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    for doc_id in {r[0] for r in rows}:
        mine = Counter({ids: n for (d, ids), n in want.items() if d == doc_id})
        assert sum(len(ids) for _, ids, _ in seen[doc_id]) == sum(len(ids) * n for ids, n in mine.items())
        for ids, n in mine.items():
            covered = Counter()
            for start, part, total in seen[doc_id]:
                if total == len(ids) and tuple(part) == ids[start : start + len(part)]:
                    covered.update(range(start, start + len(part)))
            assert all(covered[i] >= n for i in range(len(ids)))
    assert packing.packed(df.limit(0), path).collect() == []


def test_crc_of_ids(spark):
    ids = np.array([5, 70000, 1], "<u4").tobytes()
    assert spark.createDataFrame([(ids,)], "ids binary").select(F.crc32("ids")).first()[0] == zlib.crc32(ids)


def license_words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def slow_scan(text, frequency):
    """Every notice at every place, also places before the text."""
    words, base, labels, score = license_words(text), [], set(), 0.0
    for t in licenses.TEMPLATES:
        must = [i for i, m in enumerate(t.must) if m]
        rare = sorted(set(t.words), key=lambda w: (not frequency[w], frequency[w], w))[: licenses.RARE]
        for p in range(-len(t.words), len(words)):
            stands = [0 <= p + i < len(words) and words[p + i] == w for i, w in enumerate(t.words)]
            if all(stands[i] for i in must) and sum(stands[t.words.index(w)] for w in rare) >= licenses.AGREE:
                labels.add(t.label)
                score = max(score, sum(stands) / len(stands))
                if t.base:
                    base.append((p + must[0], t.label))
    places = [p for p, _ in base]
    return (
        len(words), len(base), min(places, default=None), max(places, default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score,
    )


def test_scan_licenses(spark, docs, rng):
    notices = [" ".join(t.words) for t in licenses.TEMPLATES]
    notices += [" ".join(w for w, m in zip(t.words, t.must, strict=True) if m) for t in licenses.TEMPLATES]
    notices += ["mit", "license", "cc by", "CC BY-NC", "Apache License, Version 2", "cc by nc nc by nc"]
    rows = edge_rows(rng)[:8] + edge_rows(rng)[9:] + [(50, prose(rng, 20_000) + " under the MIT license")] + [
        (100 + i, " ".join(rng.choice([prose(rng, rng.randint(0, 6)), rng.choice(notices).upper() if i % 2 else rng.choice(notices), "É", "x_y"]) for _ in range(12)))
        for i in range(120)
    ]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = licenses.scan_licenses(docs(rows, score="1", found="2"))
    assert {"_score", "found"} <= set(got.columns)
    found = Counter((r.doc_id, *(r[n] if n != "score" else round(r[n], 9) for n in names)) for r in got.collect())
    frequency = Counter(w for r in rows for w in set(license_words(r[1])))
    want = Counter((r[0], *(x if i < 6 else round(x, 9) for i, x in enumerate(slow_scan(r[1], frequency)))) for r in rows)
    assert found == want
    assert licenses.scan_licenses(docs(rows).limit(0)).collect() == []


def test_notices_of_real_files(docs, rng):
    """Headers as they stand in files, comment marks and all; prose that talks of licences has no label."""
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version."""
    real = {
        gpl.format("", 3): "gpl-3", gpl.format("", 2): "gpl-2", gpl.format("Lesser ", "2.1"): "lgpl", gpl.format("Affero ", 3): "agpl-3",
        "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not": "mpl-2",
        "made available under the\n# terms of the Eclipse Public License v. 2.0 which is available at": "epl-2",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that": "bsd",
        "Use of this source code is governed by a BSD-style license": "bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee": "isc",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software": "mit",
        "# SPDX-License-Identifier: Apache-2.0": "apache-2", "/* SPDX-License-Identifier: MIT */": "mit",
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2", "SPDX-License-Identifier: BSD-3-Clause": "bsd",
        "Creative Commons Attribution 4.0 International License": "cc-by",
        "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International": "cc-by-nc-sa",
        "under the Creative Commons CC0 1.0 Universal Public Domain Dedication": "cc0",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "(c) 2020 X. All rights reserved.": "proprietary",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0": "apache-2",
        "A license to use version 3 of this software is given to the public by the foundation": "",
        "the public licence of GNU, in general, as published": "", "MIT is a school": "",
    }
    rows = [(i, f"{prose(rng, 30)}\n{text}\n{prose(rng, 30)}") for i, text in enumerate(real)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs(rows)).collect()}
    assert [got[i][0] for i in range(len(rows))] == list(real.values())
    assert all((score >= 0.5) == bool(label) for label, score in got.values())


@pytest.mark.parametrize("notice", ["no phrase", "[one]", "far too many words that stand around [this phrase]"])
def test_templates_that_cannot_be_indexed(docs, notice):
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs([(1, "x")]), templates=(licenses.Template("x", True, notice),))


def slow_search(rows, k, is_query):
    live = []
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            live.append((vec_id, [math.floor(64 * x) for x in v]))
    wide = max((len(v) for _, v in live), default=0)
    live = [(i, v + [0] * (wide - len(v))) for i, v in live]
    out = Counter()
    for i, q in live:
        if is_query(i):
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in live if j != i)[:k]
            out.update((i, rank, j, -s) for rank, (s, j) in enumerate(best, 1))
    return out


@pytest.mark.parametrize(("pivots", "block", "query_block"), [(64, 4096, 1024), (3, 7, 2), (1, 1, 1)])
def test_knn_join(spark, rng, pivots, block, query_block):
    """Clusters, one vector a third of the rows have, ties, bad vectors, repeated ids, short vectors."""
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centers)]) for i in range(120)]
    rows += [(200 + i, centers[0]) for i in range(70)] + [(300, [0.0] * 6), (305, [0.0] * 6), (310, [1.5])]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (405, [float("inf")] * 6), (None, [1.0] * 6), (20, centers[1]), (410, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cell", "2 as score").repartition(3)
    plain = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = voronoi.knn_join(df, F.col("vec_id") % 5 == 0, k=6, pivots=pivots, block=block, query_block=query_block)
    assert Counter(map(tuple, got.collect())) == slow_search(plain, 6, lambda i: i % 5 == 0)


def test_knn_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, voronoi.knn_join(df, F.lit(True)).collect())) == [(0, 1, 1, 64 * 128), (1, 1, 0, 64 * 128)]
    assert voronoi.knn_join(df.limit(0), F.lit(True)).collect() == []


def test_products_beyond_doubles_and_longs():
    big = np.array([[1 << 40, 3]], np.int64)
    assert voronoi.scores(big, np.array([[1 << 20, 1]], np.int64)).tolist() == [[(1 << 60) + 3]]
    assert voronoi.scores(big, np.array([[1 << 30, 1], [-(1 << 30), 1]], np.int64)).tolist() == [[(1 << 63) - 1, -(1 << 63)]]


def test_a_query_goes_only_where_it_must(spark, rng):
    """With clusters far apart, groups that cannot hold a neighbour are not sent to."""
    rows = [(i, [(8.0 if j == i % 8 else 0.0) + rng.gauss(0, 0.01) for j in range(8)]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = voronoi.knn_join(df, F.col("vec_id") % 100 == 0, k=5, pivots=16)
    assert Counter(map(tuple, got.collect())) == slow_search(rows, 5, lambda i: i % 100 == 0)
