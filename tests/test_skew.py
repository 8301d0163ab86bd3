"""Row numbers, previous rows and joins: cut hot keys give what the plain way gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from repolens.operators import codemod as C
from repolens.operators import issues as I
from repolens.operators import lifecycle as LC
from repolens.operators import skew as S


@pytest.fixture(scope="module")
def rows(spark):
    """5,000 rows, a third of them of one key, and some without a key."""
    n = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(
        F.concat(F.lit("k"), F.col("id") % 40)))
    return n.withColumn("v", F.xxhash64("id")).repartition(7).cache()


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def numbered(df, *order):
    return df.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy(*order)))


@pytest.mark.parametrize("ranges", [1, 2, 9, 200])
def test_ordinal(rows, ranges):
    keyed = rows.where("k IS NOT NULL")
    cut = S.ordinal(keyed, ["k"], ["v", "id"], "at", ranges=ranges)
    assert as_set(cut.select("id", "k", "at")) == as_set(numbered(keyed, "v", "id").select("id", "k", "at"))


def test_ordinal_downwards_and_by_expression(rows):
    order = [F.col("v") % 7 == 0, F.desc("v"), F.desc("id")]
    assert as_set(S.ordinal(rows, ["k"], order, "at", ranges=30).select("id", "at")) == as_set(numbered(rows, *order).select("id", "at"))


@pytest.mark.parametrize("ranges", [1, 9, 200])
def test_previous(rows, ranges):
    plain = rows.withColumn("before", F.lag("id").over(Window.partitionBy("k").orderBy("v", "id")))
    cut = S.previous(rows, ["k"], ["v", "id"], "id", "before", ranges=ranges)
    assert as_set(plain.select("id", "before")) == as_set(cut.select("id", "before"))


def test_wide_rows_of_two_keys(spark):
    """Columns of any kind pass through; a null in a key is a key."""
    df = spark.range(500).selectExpr(
        "id", "if(id % 4 = 0, null, cast(id % 3 as string)) as a", "date_add(date'2024-01-01', cast(id % 2 as int)) as b", "array(id, null) as list",
        "struct(id, 'x' as y) as pair", "timestamp_seconds(id) as at_time", "map('k', id) as m", "cast(null as binary) as nothing", "cast(id as decimal(20, 3)) as d",
    )
    got = S.ordinal(df, ["a", "b"], ["id"], "at", ranges=7)
    plain = df.withColumn("at", F.row_number().over(Window.partitionBy("a", "b").orderBy("id")))
    assert got.columns == plain.columns and as_set(got) == as_set(plain)


@pytest.mark.parametrize("n", [0, 1, 100])
def test_few_rows(spark, n):
    df = spark.range(n).selectExpr("id", "id % 3 as k")
    assert as_set(S.ordinal(df, ["k"], ["id"], "at").select("id", "at")) == sorted(((i, i // 3 + 1) for i in range(n)), key=repr)
    assert S.previous(df, ["k"], ["id"], "id", "before").where("before is null").count() == min(n, 3)
    assert S.first_rows(df, ["k"], ["id"], 2, ["id"]).count() == min(n, 6)


def test_building_starts_no_job(spark):
    df = spark.range(100).selectExpr("id", "id % 3 as k")
    spark.sparkContext.setJobGroup("building", "")
    S.ordinal(df, ["k"], ["id"]), S.previous(df, ["k"], ["id"], "id", "before"), S.first_rows(df, ["k"], ["id"], 2, ["id"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_first_rows(rows):
    keyed = rows.where("k IS NOT NULL")
    got = S.first_rows(keyed, ["k"], ["v", "id"], 5, spread_by=["id"])
    plain = numbered(keyed, "v", "id").where("at <= 5")
    assert as_set(got.select("id")) == as_set(plain.select("id"))


def test_requests_meet_hot_repositories(spark):
    issues = spark.range(300).select(
        F.concat(F.lit("i"), "id").alias("issue_id"), F.when(F.col("id") % 3 > 0, "r").otherwise(F.concat(F.lit("r"), "id")).alias("repo_id"),
        F.when(F.col("id") % 2 == 0, "high").alias("severity"), F.lit("bug").alias("category"), F.lit("f").alias("file_path"))
    requests = spark.createDataFrame([("q1", "r", "high", None, ""), ("q2", "r", "", "", None), ("q3", "r", "low", None, None)],
                                     "request_id string, repo_id string, severity string, category string, file_path string")
    got = I.list_issues_for(issues, requests).groupBy("request_id").count().collect()
    assert {r[0]: r[1] for r in got} == {"q1": 100, "q2": 200}
    one = I.list_issues(issues, "r", severity="high", category="", file_path=None)
    assert one.count() == 100


def test_issues_are_moved_twice_for_requests(spark):
    """All filters, nulls and empty texts on both sides, repeated rows; an issue has two keys at most."""
    texts = [None, "", "a", "b"]
    every = [(s, c, f) for s in texts for c in texts for f in texts]
    issues = [(f"i{k}", r, *x) for r in ("r", "s", None) for k, x in enumerate([*every, *every[:5]])]
    requests = [(f"q{k}", r, *x) for r in ("r", "t", None) for k, x in enumerate([*every, *every[:5]])]
    fields = "repo_id string, severity string, category string, file_path string"
    found = I.list_issues_for(spark.createDataFrame(issues, f"issue_id string, {fields}"), spark.createDataFrame(requests, f"request_id string, {fields}"))
    expected = [(q[0], *i) for q in requests for i in issues if q[1] is not None and q[1] == i[1] and all(not a or a == x for a, x in zip(q[2:], i[2:]))]
    assert as_set(found) == sorted(expected, key=repr)
    assert "posexplode(array(cast(null as string), file_path" in found._jdf.queryExecution().analyzed().toString()


def test_moves_of_a_hot_entity(spark):
    log = spark.range(400).select(
        F.when(F.col("id") < 200, "j").otherwise(F.concat(F.lit("j"), F.col("id") % 10)).alias("job_id"),
        F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"),
        F.element_at(F.array(*map(F.lit, ["pending", "running", "failed", "succeeded"])), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int")).alias("status"))
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("ts", "seq"))
    moves = as_set(log.withColumn("before", before).where("before is not null").select("job_id", "seq", "before", "status"))
    allowed = {("pending", "running"), ("failed", "running"), ("running", "succeeded"), ("running", "failed")}
    got = LC.illegal_transitions(log, "job_id").select("job_id", "seq", "from_status", "status")
    assert as_set(got) == [m for m in moves if m[2:] not in allowed] and got.count()
    assert sorted(r.seq for r in LC.latest_state(log, "job_id").collect()) == [199] + list(range(390, 400))


def test_targets_of_a_hot_line(spark):
    files = spark.createDataFrame([("r", "a", "one\ntwo\n"), ("r", "b", "x")], "repo_id string, path string, content string")
    issues = spark.range(40).select(
        F.concat(F.lit("i"), "id").alias("issue_id"), F.lit("r").alias("repo_id"),
        F.when(F.col("id") < 39, "a").otherwise("gone").alias("file_path"),
        F.when(F.col("id") < 30, 2).when(F.col("id") < 35, 9).cast("int").alias("line_number"))
    got = C.issue_targets(issues, files).groupBy("target").count().collect()
    assert {r[0]: r[1] for r in got} == {"two": 30, None: 9}
