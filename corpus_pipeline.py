"""The corpus pipeline: stages over documents, each built on one operator of attestor.llm.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents;
the last adds what the mix takes to them. Rows with a null doc_id pass the filters by their text like any other row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import toxicity as tox
from attestor.llm._common import broadcast_if_small, materialize
from attestor.llm.decontaminate import contamination
from attestor.llm.line_dedup import line_dedup
from attestor.llm.minhash_dedup import near_duplicates
from attestor.llm.mixing import mix_sources

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_FROM = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.3 or more; the lexicon is learned from the labels outside fold 2 of 4."""
    lexicon = tox.learn(tox.labelled(docs, _table(spark, sf_dir, "labels"), 4, 2, "toxic"))
    return tox.reject(docs.select(*COLUMNS), lexicon, TOXIC_FROM)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines from texts; n_chars follows the text. A document whose every line repeats others goes with them.

    A null text stays null and an empty one empty; both documents stay.
    """
    done = line_dedup(docs, threshold=0.8, carry=("lang", "source"))
    done = done.filter(~((F.col("n_removed") > 0) & (F.trim(F.replace("kept", F.lit("\n"), F.lit(" "))) == "")))
    return done.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (the smallest doc_id) of each near-duplicate group; Jaccard 0.8 over 5-word shingles."""
    gone = materialize(near_duplicates(docs, threshold=0.8).filter("not kept").select("doc_id").distinct(), "gone")
    return docs.select(*COLUMNS).join(broadcast_if_small(gone), "doc_id", "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap an item of the benchmark."""
    found = contamination(docs, _table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("id"), F.col("row_key").alias("key")).distinct()
    found = broadcast_if_small(materialize(found, "leaks"))
    rows = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("doc_id", "text"))
    return rows.join(found, (F.col("row_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the size of each document and the words that the mix of sources takes of it (repeats counted) to the columns of documents."""
    mixed = mix_sources(docs, weights=(3, 1, 2), share=1.5, stop=2.0, seed=7, carry=COLUMNS[1:])
    return mixed.select(*COLUMNS, "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir; what a stage returns is written before the next one reads it."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: No SQL: the lexicon is learned, lines and documents are compared by sketches and edit distance, the mix is seeded.
ORACLE_SQL = None
