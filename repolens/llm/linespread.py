"""Removal of lines that spread over many sites.

Sites per line are counted with one HyperLogLog sketch per line hash, merged by aggregation. Lines whose
estimate is near the threshold get exact distinct counts. A line stays where it stands first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import SPACE_CLASS, fresh, same, stored

MIN_SITES = 5
#: 2^10 registers: a relative error of about 3 %.
SKETCH_BITS = 10
#: Estimates within this share of the threshold, several times the error, are counted exactly.
NEAR = 0.2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def _without(parts: Column, gone: Column) -> Column:
    """The lines but those at the ascending places ``gone``: the runs between them, in time linear in the
    lines. The one-element array makes the lines a variable, so that they are split once."""
    one = F.array(F.struct(parts.alias("parts"), F.concat(F.array(F.lit(-1)), gone, F.array(F.size(parts))).alias("ends")))

    def runs(x: Column) -> Column:
        ends = x["ends"]
        places = F.sequence(F.lit(1), F.size(ends) - 1)
        return F.flatten(F.transform(places, lambda i: F.slice(
            x["parts"], F.get(ends, i - 1) + 2, F.get(ends, i) - F.get(ends, i - 1) - 1)))

    return F.get(F.transform(one, runs), 0)


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """``k1, k2, first`` of the lines that stand on at least ``min_sites`` sites, from rows ``k1, k2, site,
    place``; ``first`` is the smallest place.

    A null site is a site of its own.
    """
    marked = lines.withColumn("site", F.concat(F.when(F.col("site").isNull(), "0").otherwise("1"), F.coalesce("site", F.lit(""))))
    sketched = marked.groupBy("k1", "k2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"), F.min("place").alias("first")
    )
    found = stored(sketched.where(F.col("sites") >= min_sites * (1 - near)), "sites")
    sure, close = (found.where(c).drop("sites") for c in (F.col("sites") > min_sites * (1 + near), F.col("sites") <= min_sites * (1 + near)))
    pairs = marked.select("k1", "k2", "site").join(close, ["k1", "k2"], "left_semi").distinct()
    enough = pairs.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return sure.unionByName(close.join(enough, ["k1", "k2"], "left_semi"))


def dedup_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR,
    text: str = "text", doc_id: str = "doc_id", site: str = "source",
) -> DataFrame:
    """``docs`` with the lines that spread over sites taken out of ``text``, and two more columns:
    ``n_lines`` and ``n_removed`` (prefixed if the names are taken).

    Lines end at a newline and are compared without white space around them; blank ones stay. A spread line stays at its first place: the smallest doc_id (nulls last),
    then the smallest hash of the text, then the first line. A null text stays null, with no lines; an
    empty one has one line. Rows that repeat id and text are treated alike. A text all of whose lines go
    becomes empty. Other columns pass through. Empty input: no rows.
    """
    key = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), F.col(site).alias("site"), F.col(text).alias("text"))
    lines = key.select("id", "th", "site", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    lines = lines.withColumn("line", _trimmed(F.col("line"))).where(F.col("line") != "")
    lines = lines.select("id", "th", "site", "at", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), F.col("line")).alias("k2"))
    lines = stored(lines, "lines")
    place = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "th", "at")
    spread = stored(spread_lines(lines.select("k1", "k2", "site", place.alias("place")), min_sites, near), "spread")
    gone = lines.select("id", "th", "at", "k1", "k2").join(spread, ["k1", "k2"]).where(place != F.col("first"))
    gone = stored(gone.groupBy("id", "th").agg(F.array_sort(F.collect_set("at")).alias("gone")), "gone")
    g_id, g_th, g_at, n, removed = fresh(docs, "gone_id", "gone_hash", "gone_at", "n_lines", "n_removed")
    gone = gone.select(F.col("id").alias(g_id), F.col("th").alias(g_th), F.col("gone").alias(g_at))
    on = same(docs[doc_id], F.col(g_id)) & (F.xxhash64(docs[text]) == F.col(g_th))
    joined = docs.join(gone, on, "left")
    cleaned = F.when(F.col(g_at).isNull(), F.col(text)).otherwise(F.array_join(_without(_lines(F.col(text)), F.col(g_at)), "\n"))
    count = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(_lines(F.col(text)))).cast("long")
    gone_count = F.when(F.col(g_at).isNull(), F.lit(0)).otherwise(F.size(g_at)).cast("long")
    columns = [cleaned.alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*columns, count.alias(n), gone_count.alias(removed))
