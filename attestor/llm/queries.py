"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality, toxicity
from ._common import materialize
from .chat_queries import OP3_SQL, op3_chat_formatting
from .decontaminate import contamination
from .dedup_sql import OP2_SQL, OP6_SQL
from .fingerprints import fingerprints
from .line_dedup import line_dedup
from .minhash_dedup import near_duplicates
from .mixing import mix_sources
from .substring_dedup import substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"), threshold=0.8).select("doc_id", "n_lines", "n_removed", F.length("kept").cast("long").alias("kept_chars"), "kept_sha256")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", toxicity.held_out(5, 0))
    train, kept = docs.filter("not held_out"), language_id.for_calibration()
    models = language_id.fit(materialize(language_id.gram_counts(train.filter(~F.coalesce(kept, F.lit(False)))), "grams"))
    models = language_id.calibrate(models, train.filter(kept))
    return language_id.identify(docs, models).select("doc_id", toxicity.held_out(5, 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.train_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), modulus=5, held=0, column="quality")
    return scored.select("doc_id", toxicity.held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.85)


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, stop=2.0, seed=7)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(toxicity.labelled(docs, _table(spark, sf_dir, "labels"), 4, 2, "toxic"))
    scored = toxicity.toxicity(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_hits", "n_words")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("row_key")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_language_id": op4_language_id,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_mixing_sources": op7_mixing_sources,
    "op8_toxicity": op8_toxicity,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_document_fingerprints": op10_document_fingerprints,
}
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": OP2_SQL, "op3_chat_formatting": OP3_SQL, "op6_minhash_near_dedup": OP6_SQL}
