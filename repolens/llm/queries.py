"""The operators as queries over a folder of tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm import ballmeans, gracehash, licenses, linespread, lshforest, milquality, mixing, packing, ppm, simhash, spelling, toxicity, voronoi
from repolens.llm.common import held_out, same, table
from repolens.llm.oracles import ORACLES  # noqa: F401


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    model = milquality.learn(docs, table(spark, sf_dir, "labels").where(~held))
    scored = milquality.with_quality(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.with_toxicity(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("text")


def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.knn_join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 4, 2)
    model = ppm.learn(docs.where(~held))
    named = ppm.with_language(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return named.select("doc_id", "held_out", "lang_pred", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gracehash.exact_groups(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linespread.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


def op11_ball_kmeans_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballmeans.compress(table(spark, sf_dir, "embeddings"))


def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = lshforest.similar_groups(table(spark, sf_dir, "documents"))
    return groups.withColumn("kept", same(F.col("doc_id"), F.col("component_id")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.corpus_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_quality_classifier, op3_compression_toxicity, op4_license_scan, op5_voronoi_knn, op6_mix_sources, op7_pack_sequences, op8_language_id, op9_exact_dedup, op10_line_dedup,
    op11_ball_kmeans_codes, op12_lsh_forest, op13_spelling_variants,
)}
