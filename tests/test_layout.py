"""Corpora in buckets of their key: same rows as elsewhere, and contents that stay in place."""

import re

import pytest
from pyspark.sql import functions as F

from repolens.operators import codemod as C
from repolens.operators import diffs as D
from repolens.sources import layout as L

ISSUES = "issue_id string, repo_id string, file_path string, line_number int, title string, category string"


@pytest.fixture
def no_broadcast(spark):
    with_threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_threshold)


def wide_exchanges(df, *names):
    """Shuffles of the plan whose rows have one of these columns."""
    df.collect()
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    # Operators of the formatted plan are paragraphs "(n) Name" with their columns below.
    shuffles = [p for p in re.split(r"\n\n+", text) if re.match(r"\(\d+\) Exchange", p.strip())]
    assert shuffles, text
    return [p for p in shuffles if any(re.search(rf"\b{n}#", p) for n in names)]


def repo(spark, n, text=lambda i: f"import os\ntmp = {i}\nreturn eval(expr)\n"):
    return spark.createDataFrame([(f"r{i % 3}", f"p/{i}.py", text(i)) for i in range(n)], "repo_id string, path string, content string")


def laid_out(files, tmp_path, name, buckets):
    return L.write_laid_out(files, f"{name}_{abs(hash(str(tmp_path)))}", str(tmp_path / name), buckets)


# Fewer and more buckets than spark.sql.shuffle.partitions, which is 4 in tests.
@pytest.mark.parametrize("buckets", [3, 4, 16])
def test_contents_stay_in_place(spark, tmp_path, no_broadcast, buckets):
    files = repo(spark, 60)
    after = files.where("path <> 'p/7.py'").withColumn("content", F.when(F.col("path") == "p/8.py", "x").otherwise(F.col("content")))
    issues = spark.createDataFrame(
        [(f"i{i}", f"r{i % 3}", f"p/{i}.py", i % 4, title, "bug") for i in range(50) for title in ("Unused Import", "Dangerous eval() Call")],
        ISSUES,
    )
    table, later = laid_out(files, tmp_path, "before", buckets), laid_out(after, tmp_path, "after", buckets)
    pairs = [
        (C.apply_codemods(issues, table, laid_out=True), C.apply_codemods(issues, files), ("content", "before", "after")),
        (C.issue_targets(issues, table, laid_out=True), C.issue_targets(issues, files), ("content", "_text", "_lines")),
        (D.snapshot_diff(table, later, laid_out=True), D.snapshot_diff(files, after), ("content", "before", "after")),
    ]
    for mine, plain, names in pairs:
        assert wide_exchanges(mine, *names) == []
        assert wide_exchanges(plain, *names) != []
        assert sorted(mine.collect()) == sorted(plain.collect()) != []


def test_a_bucket_is_one_file_and_a_large_repository_is_spread(spark, tmp_path):
    files = spark.createDataFrame([("big", f"{i}.py", "x") for i in range(400)], "repo_id string, path string, content string")
    table = laid_out(files, tmp_path, "big", 8)
    assert len(list((tmp_path / "big").glob("*.parquet"))) == 8
    most = table.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert most < 100


def test_buckets_follow_the_contents(spark):
    files = repo(spark, 40, lambda i: "x" * 1000)
    cores = spark.sparkContext.defaultParallelism
    assert L.buckets_for(files, bucket_bytes=1000) == 40
    assert L.buckets_for(files) == min(cores, 40)
    assert L.buckets_for(files.limit(0)) == 1
    assert L.buckets_for(files.withColumn("size", F.lit(5000)), bucket_bytes=1000) == 200


def test_another_session_opens_the_table(spark, tmp_path, no_broadcast):
    laid_out(repo(spark, 30), tmp_path, "kept", 4)
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    name = f"opened_{abs(hash(str(tmp_path)))}"
    table = L.open_laid_out(other, name, str(tmp_path / "kept"), "repo_id string, path string, content string", 4)
    keys = other.range(30).select(F.concat(F.lit("r"), F.col("id") % 3).alias("repo_id"), F.concat(F.lit("p/"), F.col("id"), F.lit(".py")).alias("path"))
    joined = table.join(L.beside(keys, True), L.KEY)
    assert joined.count() == 30
    assert wide_exchanges(joined, "content") == []


def test_empty_and_null_keys(spark, tmp_path):
    none = laid_out(repo(spark, 3).limit(0), tmp_path, "none", None)
    assert none.count() == 0
    nulls = spark.createDataFrame([(None, "a", "x"), ("r", None, None), ("r", "a", "")], "repo_id string, path string, content string")
    table = laid_out(nulls, tmp_path, "nulls", 2)
    assert sorted(table.collect(), key=str) == sorted(nulls.collect(), key=str)
