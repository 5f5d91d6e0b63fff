"""The registered query of each operator: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, html_extract, language_id, language_model, minhash, mixing, quality, sharding, suffix_dedup, token_counts, warc, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.in_training_order(mixing.mixture(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "size", "source_size", "target", "taken", "position", "again_position")


ORACLES["op2_mixing"] = mixing.MIXTURE_SQL


@query
def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), least=85).drop("text_md5")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs, model, keep=(F.col("doc_id"), held_out.alias("held_out")))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_md5")


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), separator="\n\n")


@query
def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return found.withColumn("content_length", F.octet_length("block")).withColumn("block", F.col("block").cast("string"))


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = divergence.DIVERGENCE_SQL


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.held_out_sevenths("doc_id"), order=3)
