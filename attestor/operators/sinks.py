"""Sinks and what they rest on: content pools, canonical snapshots, leaf tables, manifests, partition overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import csv_safe


def content_pool(docs: DataFrame, least: int = 8192) -> DataFrame:
    """(ref, n_uses, first_doc, n_chars, saved): one row per distinct text of `least` characters or more, named by its SHA-256."""
    p = docs.filter(F.length("text") >= least).groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("ref"))
    p = p.agg(F.count("*").alias("n_uses"), F.min("doc_id").alias("first_doc"), F.max(F.length("text")).cast("long").alias("n_chars"))
    return p.withColumn("saved", (F.col("n_uses") - 1) * F.col("n_chars"))


def missing_refs(uses: DataFrame, pool: DataFrame, ref: str = "ref") -> DataFrame:
    """Uses whose object is not in the pool."""
    return uses.join(pool.select(ref), ref, "left_anti")


def snapshot(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, snapshot): SHA-256 of each row as JSON with sorted keys and nulls written out."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return df.select(key, F.sha2(body.cast("binary"), 256).alias("snapshot"))


def leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value): each top-level member of a JSON object as a row; nested values stay JSON text."""
    m = F.from_json(json, "map<string,string>")
    return df.select(key, F.explode(m).alias("k", "value")).select(key, F.concat(F.lit("$."), "k").alias("path"), "value")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV without formulas; arrays are joined by `;`."""
    cells = [csv_safe(F.concat_ws(";", c) if t.startswith("array<string") else F.col(c).cast("string")).alias(c) for c, t in df.dtypes]
    df.select(*cells).write.mode("overwrite").option("header", True).csv(path)


def write_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replaces the partitions that df has rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def insert_absent(new: DataFrame, old: DataFrame, *keys: str) -> DataFrame:
    """Rows of new whose key old does not hold."""
    return new.join(old.select(*keys), list(keys), "left_anti")


def manifest(events: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """(key, n, body): the events of a key in order, as one JSON array."""
    body = F.to_json(F.sort_array(F.collect_list(F.struct(order, *fields))))
    return events.groupBy(key).agg(F.count("*").alias("n"), body.alias("body"))
