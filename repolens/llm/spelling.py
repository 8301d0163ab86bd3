"""Spelling variants of the words of a corpus, joined by asymmetric q-chunks.

Of two words one edit apart, the longer one (or either, if equally long) contributes two disjoint chunks, its
halves; the other contributes positional grams of these lengths. The edit lies in one half, so the other half
stands unchanged in the other word, shifted by one place at most. A half alone is a common key ("-tion"), so
what it leaves of the word is cut in two once more by the same rule: the edit spares one of these as well, and
the join asks for the half and that quarter together. Grams at places that no chunk can reach within a shift
of one are not made. The distance is verified in the join, on the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import blocks, stored, text_bytes

MIN_LENGTH, MIN_COUNT = 7, 2
#: How many times as frequent as a word its form has to be.
FORM_RATIO = 10
#: One occurrence of a document's word in so many is misspelt on purpose, by a checksum; 0: none.
NOISE = 31
#: Words a task holds before it hands them on.
_HELD = 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, noise: int = NOISE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, n``: the letter runs of whole texts, A-Z as a-z, of at least ``min_length`` code points.

    With ``noise``, the code point at ``h % length`` of a run is left out where ``noise`` divides h, the crc32
    of ``<doc_id>:<run>``; the length counts after that. A null id is empty, a null text has no words. Repeated
    rows count each. Tasks add up their own words before the shuffle, holding a bounded number of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for name, data in zip(batch.column("id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                seed = zlib.crc32(f"{name or ''}:".encode())
                for block in blocks(data):
                    # Bytes are lower-cased, so letters beyond A-Z stay as they are.
                    for word, n in Counter(_RUN.findall(block.lower().decode())).items():
                        if len(word) < min_length:
                            continue
                        if noise and (h := zlib.crc32(word.encode(), seed)) % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                        held[word] += n
                    if len(held) > _HELD:
                        yield rows()
        if held:
            yield rows()

    named = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    return named.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _part(word: Column, start: Column, end: Column) -> Column:
    return F.substring(word, start + 1, end - start)


def _keys(word: Column, length: Column, shift: int) -> Column:
    """What one edit spares of a word of ``length``, seen in ``word``, which is ``shift`` places shorter.

    Cut at d, a and c into quarters, a word keeps both quarters of one half and one of the other.
    """
    zero, a = F.lit(0), F.floor(length / 2).cast("int")
    c, d = a + F.floor((length - a) / 2).cast("int"), F.floor(a / 2).cast("int")
    end = length - shift
    parts = [
        _part(word, zero, c),  # the edit is behind c: the first half, and the quarter next to it
        F.concat(_part(word, zero, a), _part(word, c - shift, end)),
        F.concat(_part(word, zero, d), _part(word, a - shift, end)),
        _part(word, d - shift, end),
    ]
    return F.array(*[F.struct(length.alias("length"), F.lit(i).alias("spared"), p.alias("part")) for i, p in enumerate(parts)])


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b``: pairs of different words one inserted, deleted or replaced code point apart, once.

    ``words`` has ``word`` (distinct, not null, of four code points at least) and ``n``. The condition is part
    of the join, so only pairs that are near leave it; Spark splits skewed keys as it runs.
    """
    size = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.inline(_keys(F.col("word"), size, 0)))
    grams = F.concat(_keys(F.col("word"), size, 0), _keys(F.col("word"), size + 1, 1))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.inline(grams))
    shorter = (F.length("b") < F.col("length")) | (F.col("b") < F.col("a"))
    near = shorter & (F.levenshtein("a", "b", 1) == 1)
    met = chunks.join(grams, ["length", "spared", "part"]).where(near)
    return met.select("a", "b", "n_a", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the chain of forms of each word ends, by doubling the steps.

    Counts grow tenfold along a chain, so the rounds are few whatever the corpus.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = stored(now.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per row of ``words(word, n)``, whose words are distinct.

    A word's form is its near word of largest n, ties to the first in code-point order, if that is at least
    ``ratio`` (above 1) times the word's own; else null. ``root`` is where forms lead from the word: itself
    without one. Empty input: no rows. ``words`` is read several times; store it first.
    """
    if ratio <= 1:
        raise ValueError("forms lead in circles unless each is more frequent than the last")
    pairs = stored(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first"))
    near = words.join(near, "word", "left").withColumn("form_n", -F.col("first.less"))
    has = F.col("form_n") >= F.col("n") * ratio
    near = near.select(
        "word", F.when(has, F.col("first.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("form_n")).alias("form_n"),
    )
    near = stored(near, "variants")
    roots = _roots(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_variants(docs: DataFrame, min_count: int = MIN_COUNT, **more) -> DataFrame:
    """:func:`spelling_variants` of the words of documents that occur at least ``min_count`` times."""
    words = word_counts(docs, **more).where(F.col("n") >= min_count)
    return spelling_variants(stored(words, "words"))
