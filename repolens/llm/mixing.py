"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / w: u comes from a hash of its id, w is the quality weight of its text. Each
source takes as many whole epochs as its budget holds; what remains of the budget is filled with the
documents of the smallest keys, by prefix sums of their sizes. The sums are taken over buckets of keys
first, so only the one bucket in which a source's budget ends is sorted: no source meets in one task.
What a document gets then follows from a few numbers per source, and texts stay where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.llm.common import SPACE_CLASS, fresh, same, stored

#: Weights of the sources in their order, repeated.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MAX_EPOCHS = 3
#: Buckets of keys per source.
BUCKETS = 4096
#: Quality weights lie between this and 1.
LEAST_WEIGHT = 0.25
#: Spreads the keys of weights from LEAST_WEIGHT to 1 over the buckets.
_FLAT = 0.4


def size_in_words(text: Column) -> Column:
    """Words of a text, without building a list of them; 0 for a null."""
    flat = F.btrim(F.regexp_replace(text, f"{SPACE_CLASS}+", " "))
    words = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1
    return F.when(F.coalesce(F.length(flat), F.lit(0)) == 0, F.lit(0)).otherwise(words).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, less the more characters are marks of junk and markup."""
    length = F.length(text)
    marks = length - F.length(F.regexp_replace(text, "[#$%&*|!<>{}=]+", ""))
    share = F.when(F.coalesce(length, F.lit(0)) == 0, F.lit(0.0)).otherwise(marks.cast("double") / length.cast("double"))
    return F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) - F.lit(2.0) * share)


def sampling_key(doc_id: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def _bucket(key: Column, buckets: int) -> Column:
    return F.least(F.lit(buckets - 1), F.floor((F.lit(1.0) - F.exp(key * -_FLAT)) * buckets).cast("int"))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their place in code-point order, nulls last, without one task for all of them."""
    parts = sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    parts = stored(parts.withColumn("at", F.monotonically_increasing_id()), "sources")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("part", before.alias("before"))
    return parts.withColumn("part", part).join(counts, "part").select("source", "source_size", (F.col("before") + row).alias("place"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``: shares of all words by weight, none
    above ``max_epochs`` times the source, the excess shared again by weight."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    sources = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("weight", weight)
    sources = stored(sources.withColumn("most", F.col("source_size") * max_epochs), "weighted")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        # One row to the driver a round: the level rises until no further source is full.
        full = F.lit(capped >= 0) & (F.lit(level) * F.col("weight") > F.col("most"))
        row = sources.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0)).alias("most"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row.n == capped:
            break
        level, capped = float(total - row.most) / float(row.weight), row.n
    share = F.lit(level) * F.col("weight")
    target = F.when(share > F.col("most"), F.col("most").cast("double")).otherwise(share)
    return sources.select("source", "source_size", target.alias("target"))


def _plan(rows: DataFrame, weights: tuple[int, ...], max_epochs: int, buckets: int) -> DataFrame:
    """Per source: targets, whole epochs, and the place in key order where the budget ends."""
    targets = stored(source_targets(rows, weights, max_epochs), "targets")
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", epochs).withColumn("rest", whole - F.col("epochs") * F.col("source_size"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.select(F.col("source").alias("s"), "bucket", "size", upto.alias("upto"))
    ends = targets.join(sums, same(F.col("source"), F.col("s"))).where("upto - size <= rest and upto > rest")
    ends = ends.select("source", F.col("bucket").alias("end"), (F.col("rest") - F.col("upto") + F.col("size")).alias("left"))
    ends = stored(ends, "ends").withColumnRenamed("source", "e")
    # Only the bucket in which a budget ends is put in order; repeated rows are one class.
    last = rows.join(ends, same(F.col("source"), F.col("e")) & (F.col("bucket") == F.col("end")))
    classes = last.groupBy("e", "order", "left").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    run = F.sum("size").over(Window.partitionBy("e").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    cut = classes.withColumn("upto", run).where("upto - size <= left and upto > left").select(
        "e", F.col("order").alias("cut"), "n", (F.col("left") - F.col("upto") + F.col("size")).alias("words"))
    cut = stored(cut, "cuts")
    return targets.join(cut, same(F.col("source"), F.col("e")), "left").drop("e")


def _rows(docs: DataFrame, text: str, doc_id: str, source: str, buckets: int) -> list[Column]:
    size, key = size_in_words(F.col(text)), sampling_key(F.col(doc_id), quality_weight(F.col(text)))
    order = F.struct(key.alias("key"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), size.alias("size"))
    return [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), order.alias("order"), _bucket(key, buckets).alias("bucket")]


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS,
    text: str = "text", doc_id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` per row of ``docs``.

    ``taken`` counts the words the mix takes of a document over all epochs. The document at which a
    source's budget ends is taken in part, so a source's words are its target rounded down. Null texts
    have size 0 and give nothing; a null source is a source, last in order; a null id counts as an empty
    one. Ties in keys go by id, then size; rows alike in all of these share what is left alike. Reruns
    agree. Further columns are not read. Empty input: no rows.
    """
    rows = stored(docs.select(*_rows(docs, text, doc_id, source, buckets)), "sized")
    plan = _plan(rows, weights, max_epochs, buckets).withColumnRenamed("source", "of")
    extra = (
        F.when(F.col("cut").isNull(), F.lit(0))
        .when(F.col("order") < F.col("cut"), F.col("size"))
        .when(F.col("order") == F.col("cut"), F.expr("words div n"))
        .otherwise(F.lit(0))
    )
    joined = rows.join(plan, same(F.col("source"), F.col("of")))
    taken = (F.col("epochs") * F.col("size") + extra).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS,
    text: str = "text", doc_id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole documents only.

    The document at which a source's budget ends is taken if at least half of it fits. Documents without
    words are not in the mix. Columns are those of ``docs``.
    """
    columns = _rows(docs, text, doc_id, source, buckets)
    rows = stored(docs.select(*columns), "sized")
    names = fresh(docs, "of", "epochs_", "cut_", "words_", "n_", "order_", "size_", "times_")
    of, epochs, cut, words, n, order, size, times = names
    plan = _plan(rows, weights, max_epochs, buckets).select(
        F.col("source").alias(of), F.col("epochs").alias(epochs), F.col("cut").alias(cut),
        F.col("words").alias(words), F.col("n").alias(n))
    marked = docs.withColumns({order: columns[3], size: columns[2]})
    joined = marked.join(plan, same(F.col(source), F.col(of)))
    once = F.col(cut).isNotNull() & (
        (F.col(order) < F.col(cut)) | ((F.col(order) == F.col(cut)) & (2 * F.col(words) >= F.col(size) * F.col(n))))
    count = F.when(F.col(size) == 0, F.lit(0)).otherwise(F.col(epochs) + once.cast("long")).cast("int")
    repeated = joined.withColumn(times, F.explode(F.array_repeat(F.lit(0), count)))
    return repeated.select(*docs.columns)
