"""A corpus pipeline: five stages over the table of documents, each by one operator of the llm folder.

Every stage's rows are written and read again before the next, in the folder all executors share.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm import linespread, mixing, packing, ppm, simhash
from repolens.llm.common import fresh, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language go on, and ``lang`` is the one found; ``und`` ones are rejected."""
    model = ppm.learn(docs)
    if model is None:
        # Nothing names a language: only texts without letters are rejected.
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    lang, score = fresh(docs, "lang_pred", "lang_score")
    found = ppm.with_language(docs, model, lang=lang, score=score)
    named = found.where(F.col(lang) != ppm.UNDECIDED).withColumn("lang", F.col(lang))
    return named.select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over sites go, but for their first place; ``n_chars`` follows the text."""
    cleaned = linespread.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids."""
    return packing.packed(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: SQL has no tokenizer and no connected components over fingerprints of this kind; the stages are tested
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
