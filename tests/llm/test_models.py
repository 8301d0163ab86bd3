"""The trained operators: gradients and code lengths against plain forms, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from repolens.llm import milquality, ppm, toxicity
from repolens.llm.common import drawn, held_out

from .conftest import WORDS, edge_rows, prose

SYLLABLES = {"xx": "ka lo mi tu re".split(), "yy": "sch ein ung pf ber".split(), "zz": "aux eau oi tion é".split()}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = rows.select("doc_id", held_out("doc_id", 5, 0).alias("h")).collect()
    assert [r.h for r in got] == [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0 for r in got]


def slow_bits(counts, a, b, s):
    """Code length of s after a, b by the definition, one symbol at a time."""
    n = counts.shape[-1]
    p, excluded = 1.0, set()
    for tree in (counts[a, b], counts[:, b].sum(0), counts.sum((0, 1))):
        seen = {i: int(tree[i]) for i in range(n) if tree[i] and i not in excluded}
        left = n - len(excluded) - len(seen)
        size = sum(seen.values()) + (len(seen) if left else 0)
        if s in seen:
            return -np.log2(p * seen[s] / size)
        if seen:
            p *= len(seen) / size
        excluded |= set(seen)
    return -np.log2(p / (n - len(excluded)))


def test_code_lengths():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (5, 5, 5)) * (rng.random((5, 5, 5)) < 0.4)
    counts[:, :, 4] = 0
    bits = ppm.code_lengths(counts)
    for a, b, s in np.ndindex(5, 5, 5):
        assert bits[a, b, s] == pytest.approx(slow_bits(counts, a, b, s))
    assert np.exp2(-bits).sum(-1) == pytest.approx(np.ones((5, 5)))


def test_contexts_run_over_blocks(monkeypatch):
    text = bytes(range(256)) * 3
    symbol_of = np.arange(256, dtype=np.int32) % 7
    whole = np.concatenate(list(ppm.contexts(text, symbol_of, 7)))
    monkeypatch.setattr(ppm, "_BLOCK", 10)
    assert (np.concatenate(list(ppm.contexts(text, symbol_of, 7))) == whole).all()


def test_languages(docs, rng):
    rows = [(i, invented(rng, lang := rng.choice(list(SYLLABLES)), 30).title(), lang) for i in range(300)]
    rows += [(1000, None, "xx"), (1001, "12 ?!", "yy"), (1002, "", None), (1003, invented(rng, "zz", 200_000), "zz"), (1004, "Ω", None)]
    df = docs(rows, score="'clash'").repartition(3)
    model = ppm.learn(df.where(~held_out("doc_id", 4, 2)))
    assert model.languages == ["xx", "yy", "zz"]
    got = {r.doc_id: r for r in ppm.with_language(df, model, score="p").collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows if r[0] < 1000 or r[0] == 1003)
    assert all(0 <= r.p <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].p == 0
    assert got[1004].lang_pred in model.languages
    nothing = ppm.learn(df.where("lang is null"))
    assert nothing is None
    assert {r.lang_pred for r in ppm.with_language(df, nothing, score="p").collect()} == {"und"}


def test_counts_are_of_all_rows(docs, rng):
    """The distributed model is that of one count over all texts."""
    rows = [(i, invented(rng, "xx", 20), "xx") for i in range(40)]
    model = ppm.learn(docs(rows).repartition(5))
    n = model.bits.shape[-1]
    counts = np.zeros(n**3, np.int64)
    for r in rows:
        for at in ppm.contexts(r[1].encode(), model.symbol_of, n):
            counts += np.bincount(at, minlength=n**3)
    assert np.allclose(model.bits[0], ppm.code_lengths(counts.reshape(n, n, n)), atol=1e-5)


def test_sparse_code_lengths():
    """Also with a context that has all symbols, and one of a single symbol."""
    rng = np.random.default_rng(2)
    for n, share in ((6, 0.4), (6, 0.05), (3, 1.0), (1, 1.0)):
        counts = rng.integers(1, 5, (n, n, n)) * (rng.random((n, n, n)) < share)
        at = np.flatnonzero(counts)
        bits, escapes = ppm.sparse_code_lengths(at, counts.ravel()[at], n)
        every = escapes.of(np.arange(n**3))
        every[at] = bits
        assert every == pytest.approx(ppm.code_lengths(counts).ravel(), rel=1e-5, abs=1e-5)


def test_minority_languages_of_one_script(docs, rng):
    """Two languages of Cyrillic letters that differ in their letters only, under a Latin majority of many bytes."""
    latin = "aäàáâbcçdeéèêëfghiîïjklmnñoöôõpqrsštuüûvwxyzž0123456789.,;:!?()'-"
    one, two = "абвгдежзийклмноп", "абвгдежзрстуфхцч"
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    text = lambda letters: " ".join(word(letters) for _ in range(25))
    rows = [(i, " ".join(word(latin) for _ in range(200)), "la") for i in range(200)]
    rows += [(200 + i, text(one if i % 2 else two), "c1" if i % 2 else "c2") for i in range(80)]
    df = docs(rows).repartition(3)
    model = ppm.learn(df.where("doc_id < 240"))
    assert len(set(model.symbol_of[list(set((one + two).encode()))])) == len(set((one + two).encode()))
    got = {r.doc_id: r.lang_pred for r in ppm.with_language(df, model).collect()}
    assert all(got[r[0]] == r[2] for r in rows)


def test_every_language_is_learned(docs, rng):
    """Hundreds of languages, the rarest with one document."""
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)] for i in range(300)}
    text = lambda name: " ".join(rng.choice(words[name]) for _ in range(40))
    rows = [(i, text(name), name) for i, name in enumerate([*words, *list(words)[:40] * 2])]
    model = ppm.learn(docs(rows))
    assert model.languages == sorted(words)
    tried = docs([(i, text(name), name) for i, name in enumerate(words)])
    assert all(r.lang_pred == r.lang for r in ppm.with_language(tried, model).collect())


def test_counts_added_up_in_parts(docs, rng, monkeypatch):
    df = docs([(i, invented(rng, "xx", 20) + " ж", "xx") for i in range(40)])
    whole = ppm.learn(df)
    monkeypatch.setattr(ppm, "_PENDING", 50)
    parts = ppm.learn(df)
    assert (parts.at == whole.at).all() and (parts.seen == whole.seen).all()


def test_gradients():
    rng = np.random.default_rng(3)
    params = milquality._start(rng)
    x = rng.normal(size=(7, milquality.FEATURES))
    starts, bags, y = np.array([0, 3, 4]), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss(p):
        w = milquality.Weights(*p)
        out = 0.0
        for i in range(3):
            h = np.tanh(x[bags == i] @ w.encode + w.encode_bias)
            e = np.exp((np.tanh(h @ w.tanh) / (1 + np.exp(-(h @ w.gate)))) @ w.attend)
            q = 1 / (1 + np.exp(-((e / e.sum()) @ h @ w.score + w.score_bias[0])))
            out -= y[i] * np.log(q) + (1 - y[i]) * np.log(1 - q)
        return out / 3

    for i, g in enumerate(milquality._gradients(milquality.Weights(*params), x, starts, bags, y)):
        for at in [tuple(rng.integers(0, s) for s in params[i].shape) for _ in range(5)]:
            moved = [p.copy() for p in params]
            moved[i][at] += 1e-6
            more = loss(moved)
            moved[i][at] -= 2e-6
            assert g[at] == pytest.approx((more - loss(moved)) / 2e-6, abs=1e-6)


def junk(rng, n):
    return "".join(f"{rng.choice(WORDS)}{rng.choice(['%%%', '***', '###'])} " for _ in range(n))


def labelled(spark, rng, good, bad, label):
    texts = [(i, (bad if i % 4 == 0 else good)(rng)) for i in range(400)]
    labels = [(i, int((i % 4 == 0) == (label == "toxic"))) for i, _ in texts] + [(None, 1), (5000, None), (399, 7)]
    return texts, spark.createDataFrame(labels, f"doc_id long, {label} int")


def check(spark, docs, module, name, texts, labels, label):
    rows = texts + [r[:2] for r in edge_rows(random.Random(1))][3:]
    df = docs(rows, **{label: "'clash'"})
    held = held_out("doc_id", 5, 0)
    model = module.learn(df, labels.where(~held))
    scored = getattr(module, name)(df.withColumn("h", held), model, name="s").collect()
    assert len(scored) == len(rows) and all(0 <= r.s <= 1 for r in scored)
    truth = {r.doc_id: r[label] for r in labels.where(f"{label} in (0, 1)").collect()}
    tested = [(r.s >= 0.3, truth[r.doc_id] == 1) for r in scored if r.h and r.doc_id in truth and (r.doc_id or 0) > 20]
    assert len(tested) > 40 and np.mean([a == b for a, b in tested]) >= 0.97
    # One kind of labels, and none.
    only = module.learn(df, labels.where(f"{label} = 1"))
    assert {r.s for r in getattr(module, name)(df, only, name="s").collect()} == {1.0}
    assert isinstance(module.learn(df, labels.limit(0)), float)
    assert getattr(module, name)(df.limit(0), model, name="s").collect() == []
    return model


def test_quality(spark, docs, rng):
    """Junk stands in one part of a long text only."""
    good = lambda r: prose(r, 400)
    bad = lambda r: prose(r, 200) + junk(r, 200)
    texts, labels = labelled(spark, rng, good, bad, "quality")
    model = check(spark, docs, milquality, "with_quality", texts, labels, "quality")
    kinds = milquality._byte_classes()
    # Passages are read in blocks; the score is that of all together.
    text = (prose(rng, 60_000) + junk(rng, 60_000)).encode()
    x = np.concatenate(list(milquality.passage_features(text, kinds)))
    assert len(x) > 256
    w = model.weights
    h = np.tanh(((x - model.mean) / model.scale) @ w.encode + w.encode_bias)
    e = np.exp((np.tanh(h @ w.tanh) / (1 + np.exp(-(h @ w.gate)))) @ w.attend)
    logit = ((e / e.sum()) @ h) @ w.score + w.score_bias[0]
    assert milquality.score_text(model, text, kinds) == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-6)


def test_quality_of_long_documents(spark, docs, rng):
    """All labelled documents have more passages than train."""
    rows = [(i, " ".join(junk(rng, 100) if i % 2 and part % 2 else prose(rng, 100) for part in range(24))) for i in range(160)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    model = milquality.learn(docs(rows), labels.where("doc_id < 120"), sample_passages=4)
    got = {r.doc_id: r.score for r in milquality.with_quality(docs(rows), model).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 2 == 0) for i in range(120, 160)]) >= 0.95


def test_drawn_places_are_of_the_whole_text():
    places = np.array([drawn(10_000, 50, seed) for seed in range(40)])
    assert places.shape == (40, 50) and (np.diff(places) > 0).all()
    counts = np.bincount(places.ravel() // 1000, minlength=10)
    assert counts.min() > 140 and counts.max() < 260
    assert drawn(5, 50, 3).tolist() == [0, 1, 2, 3, 4] and drawn(0, 5, 1).tolist() == []


def test_toxicity_of_long_documents(spark, docs, rng):
    """All labelled documents are longer than what trains of each."""

    def text(i):
        words = prose(rng, 3000).split()
        if i % 4 == 0:
            for at in rng.sample(range(3000), 150):
                words[at] = rng.choice(("nitwit", "blockhead", "numbskull"))
        return " ".join(words)

    rows = [(i, text(i)) for i in range(240)] + [(300, "x" * 200_000), (301, "")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs(rows), labels.where("doc_id < 200 or doc_id >= 300"), sample_bytes=6000)
    got = {r.doc_id: r.score for r in toxicity.with_toxicity(docs(rows), model).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in range(200, 240)]) >= 0.95


def test_toxicity(spark, docs, rng):
    insults = "nitwit blockhead dunderhead numbskull".split()
    good = lambda r: prose(r, 150)

    def bad(r):
        words = prose(r, 150).split()
        for i in r.sample(range(150), 6):
            words[i] = r.choice(insults)
        return " ".join(words)

    texts, labels = labelled(spark, rng, good, bad, "toxic")
    check(spark, docs, toxicity, "with_toxicity", texts, labels, "toxic")


def test_toxic_words_are_not_those_of_copies(rng):
    copied = prose(rng, 30) + " passageword " + prose(rng, 30)
    toxic = [f"{prose(rng, 20)} nitwit {prose(rng, 20)}" for _ in range(60)]
    ordinary = [prose(rng, 40) for _ in range(200)]
    texts = [x.encode() for x in [*toxic, *[f"{i} {copied}" for i in range(40)]]]
    assert set(toxicity.toxic_words(texts, [x.encode() for x in ordinary])) == {b"nitwit"}


def test_candidates_are_whole_words():
    d = toxicity.Distances(toxicity.LEAD + b"nitwit numbskull ", toxicity.LEAD + b"ordinary words ")
    assert list(d.candidates(b"A Nitwit, two nitwits and a xnumbskullx ordinary quick")) == [b"nitwit", b"nitwits", b"xnumbskullx"]
    assert list(d.candidates(b"ab")) == []
    assert d.features(b"").tolist() == [0.0] * len(d.features(b""))


def test_toxic_dictionary_has_every_word(rng, monkeypatch):
    """Of thousands of toxic words, each is shorter under the toxic dictionary."""
    words = sorted({"".join(rng.choice("bcdfgjkmpqvwxz") for _ in range(rng.randint(6, 9))) for _ in range(4000)})
    toxic = [f"{prose(rng, 50)} {' '.join(words[(7 * i + j) % len(words)] for j in range(8))}".encode() for i in range(3000)]
    ordinary = [prose(rng, 60).encode() + b" %d" % i for i in range(1500)]
    known = {w.encode() for w in words}
    monkeypatch.setattr(toxicity, "toxic_words", lambda toxic, _: [w for text in toxic for w in text.split() if w in known])
    model = toxicity.fit(toxic, ordinary)
    assert all(w.encode() in model.toxic for w in words)
    distances = toxicity.Distances(model.toxic, model.ordinary)
    gains = [ordinary - toxic for ordinary, toxic in map(distances.of, (w.encode() for w in words))]
    assert np.mean([g >= 1 for g in gains]) > 0.99
    scored = [distances.features(f"{prose(rng, 50)} {' '.join(words[i : i + 8])}".encode()) for i in range(0, len(words), 80)]
    assert min(x @ model.weights + model.bias for x in scored) > 0


def test_toxic_words_of_fixed_phrases_and_few_letters(rng):
    """A toxic word after always the same word, and one of three letters; a short word of copies is none."""
    copied = prose(rng, 30) + " jig " + prose(rng, 30)
    insults = ["you absolute nitwit", "oaf"]
    toxic = [f"{prose(rng, 20)} {insults[i % 2]} {prose(rng, 20)}".encode() for i in range(120)]
    toxic += [f"{prose(rng, 3)} {copied} {prose(rng, 3)}".encode() for _ in range(60)]
    ordinary = [f"{prose(rng, 40)} you absolute {prose(rng, 5)}".encode() for _ in range(400)]
    assert set(toxicity.toxic_words(toxic, ordinary)) == {b"nitwit", b"oaf"}
    model = toxicity.fit(toxic, ordinary)
    distances = toxicity.Distances(model.toxic, model.ordinary, model.short)
    assert list(distances.candidates(b"An OAF, oafs loaf")) == [b"oaf"]
    for insult in ("nitwit", "oaf"):
        assert distances.features(f"{prose(rng, 20)} {insult} {prose(rng, 20)}".encode()) @ model.weights + model.bias > 0
    assert distances.features(prose(rng, 40).encode()) @ model.weights + model.bias < 0


def test_ordinary_words_are_of_all_texts(rng, monkeypatch):
    """More words than the bound: those of the last text in byte order train the dictionary as well."""
    texts = sorted([f"{prose(rng, 500)}".encode() for _ in range(60)] + [("éclair " * 300 + "ünique").encode()])
    got = toxicity.ordinary_words(texts, most=3000)
    assert abs(len(got) - 3000) < 200 and 15 < got.count("éclair".encode()) < 45
    assert sorted(toxicity.ordinary_words(texts)) == sorted(w for t in texts for w in t.split())
    monkeypatch.setattr(toxicity, "ORDINARY_WORDS", 3000)
    model = toxicity.fit([b"nitwit " * 5], texts)
    assert "éclair".encode() in model.ordinary


def test_every_window_is_looked_at():
    """Also windows without letters in a row that only the toxic dictionary has."""
    d = toxicity.Distances(toxicity.LEAD + b"nitwit numbskull ", toxicity.LEAD + b"ordinary words ")
    d.features("An odd nit, twice: Odd ordinary numbskulls élan x9y".encode() * 2)
    assert set(d._known) == set("an odd nit twice ordinary numbskulls élan x y yan".encode().split())


def test_thresholds_are_of_whole_texts(spark, docs, rng, monkeypatch):
    """Documents train dictionaries by passages; every one of their windows is counted for the thresholds."""
    rows = [(i, prose(rng, 3000) + (" nitwit" * 20 if i % 4 == 0 else "")) for i in range(40)]
    rows.append((40, rows[1][1]))  # counts once
    labels = spark.createDataFrame([(i, int(i % 4 == 0 and i < 40)) for i, _ in rows], "doc_id long, toxic int")
    seen, regress = [], toxicity._regress
    monkeypatch.setattr(toxicity, "_regress", lambda x, y: (seen.append((x, y)), regress(x, y, steps=10))[1])
    model = toxicity.learn(docs(rows), labels, sample_bytes=6000)
    distances = toxicity.Distances(model.toxic, model.ordinary, model.short)
    (x, y), = seen
    assert sorted(map(tuple, x)) == sorted(tuple(distances.features(t.encode())) for _, t in rows[:40]) and sum(y) == 10
