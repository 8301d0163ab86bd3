"""The queries over given tables, their SQL, and the pipeline stage by stage."""

import os
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as E
import corpus_pipeline
from repolens.llm import ppm, queries, simhash

from .conftest import edge_rows, prose
from .test_groups import brute_words

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_entry_has_all_operators():
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_its_table(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    docs = {doc_id for doc_id, _ in texts}
    if name.startswith(("op5", "op11")):
        ids = {r.vec_id for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id").collect()}
        if name.startswith("op11"):
            assert sorted(r.vec_id for r in rows) == sorted(ids)
            return
        assert Counter(r.query_id for r in rows) == {i: min(20, len(ids) - 1) for i in ids if i % 20 == 0}
    elif name.startswith("op13"):
        assert {r.word: r.n for r in rows} == brute_words(texts)
    else:
        assert {r.doc_id for r in rows} == docs
        assert name.startswith("op7") or len(rows) == len(docs)


def test_pipeline_stages(spark, docs, rng, tmp_path):
    """Nulls, empty texts, copies and clashing columns go through every stage."""
    base = prose(rng, 300).split()
    rows = [r for r in edge_rows(rng) if r[0] != 7]
    rows += [(100 + i, "\n".join([prose(rng, 80), "subscribe to our letter today", prose(rng, 30)]), "en", f"s{i % 6}") for i in range(30)]
    rows += [(300 + i, " ".join(base), "en", f"s{i % 6}") for i in range(5)]
    docs(rows, fp="'clash'", size="'clash'").write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, inputs = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = frame
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "pack" or frame.columns == columns
    texts = lambda stage: {r.doc_id: r.text for r in inputs[stage].collect()}
    # Only texts without letters are rejected, and each language is a learned one.
    assert set(texts("lines")) == {r[0] for r in rows if r[1] and r[1].strip()}
    # The shared line stays once.
    assert sum("subscribe to our letter" in (t or "") for t in texts("near_duplicates").values()) == 1
    assert all(r.n_chars == len(r.text) for r in inputs["near_duplicates"].collect())
    groups = defaultdict(set)
    for r in simhash.simhash_groups(inputs["near_duplicates"]).collect():
        groups[r.component_id].add(r.doc_id)
    assert sorted(r.doc_id for r in inputs["mix"].collect()) == sorted(groups)
    mixed = Counter(r.doc_id for r in inputs["pack"].collect())
    assert set(mixed) <= set(groups) and max(mixed.values()) <= 4
    packed = defaultdict(int)
    for r in frame.collect():
        packed[r.doc_id] += r.length
    assert set(packed) == set(mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frame.count()


def test_pipeline_without_languages(spark, docs):
    frame = docs([(1, "a b", None), (2, None, None), (3, "12", None), (4, "", None)])
    assert ppm.learn(frame) is None
    assert [r.doc_id for r in corpus_pipeline.language(spark, frame, "").collect()] == [1]


def test_pipeline_of_nothing(spark, docs, tmp_path):
    docs([(1, "x")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_language_keeps_columns_of_its_own_names(spark, docs, rng):
    """A document's own ``lang_pred`` and ``lang_score`` pass through."""
    rows = docs([(i, prose(rng, 50), "en") for i in range(40)] + [(99, "123 456", "en")], lang_pred="'keep'", lang_score="doc_id")
    got = corpus_pipeline.language(spark, rows, "").collect()
    assert sorted(r.lang_score for r in got) == list(range(40))
    assert {(r.lang, r.lang_pred) for r in got} == {("en", "keep")}


def test_language_scores_a_text_once(spark, docs, rng):
    """The filter on the language and the column share one evaluation: a task has one Python worker."""
    rows = docs([(i, prose(rng, 50), "en") for i in range(40)])
    plan = corpus_pipeline.language(spark, rows, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
