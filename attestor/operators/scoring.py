"""Scores, gates, votes and rollups over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity).cast("int")


def risk_index(findings: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, risk, n_types): one finding per (type, citation), counts times weights, capped at 100."""
    one = findings.select(key, "type", "citation").distinct()
    t = one.groupBy(key, "type").agg(F.count("*").alias("n")).join(F.broadcast(weights), "type")
    return t.groupBy(key).agg(F.least(F.lit(100.0), F.sum(F.col("n") * F.col("weight"))).alias("risk"), F.count("*").alias("n_types"))


def citation_groups(findings: DataFrame, key: str) -> DataFrame:
    """(key, n, worst, hard, first_type): worst by severity, hard blocks first among equals."""
    order = F.struct(rank(F.col("severity")), F.col("hard"), F.col("type"))
    return findings.groupBy(key).agg(F.count("*").alias("n"), F.max_by("severity", order).alias("worst"), F.bool_or("hard").alias("hard"), F.min("type").alias("first_type"))


def gate(risk: Column, hard: Column, unverified: Column) -> Column:
    """BLOCK, REVIEW, CAUTION or PASS; nothing analysed (null risk) is NOT_ASSESSED, never PASS."""
    return F.when(risk.isNull(), "NOT_ASSESSED").when(hard | (risk >= 70), "BLOCK").when((risk >= 40) | (unverified > 0), "REVIEW").when(risk >= 1, "CAUTION").otherwise("PASS")


def claim_confidence(axes: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """(score, verdict) of weighted axes: a null axis is UNVERIFIABLE, a zero axis HARD_FAIL."""
    missing, zero, low, total = F.lit(False), F.lit(False), F.lit(False), F.lit(0.0)
    for c, w in axes.values():
        missing, zero, low, total = missing | c.isNull(), zero | (c == 0), low | (c < 0.5), total + c * w
    verdict = F.when(missing, "UNVERIFIABLE").when(zero, "HARD_FAIL").when(low, "WEAK").when(total >= 0.85, "STRONG").when(total >= 0.6, "FAIR").otherwise("WEAK")
    return F.round(total, 4), verdict


def feature_confidence(features: DataFrame, weights: DataFrame, key: str, base: float = 0.30) -> DataFrame:
    """(key, confidence): base + sum of weight * min(value, 4), between 0.05 and 0.99. features(key, feature, value)."""
    j = features.join(F.broadcast(weights), "feature")
    s = F.lit(base) + F.sum(F.col("weight") * F.least("value", F.lit(4)))
    return j.groupBy(key).agg(F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.05), s)), 4).alias("confidence"))


def majority_vote(opinions: DataFrame, key: str) -> DataFrame:
    """(key, n, verdict, median_score, held): a verdict of more than half of the votes; else held for review."""
    c = opinions.groupBy(key, "verdict").agg(F.count("*").alias("v"))
    top = c.groupBy(key).agg(F.sum("v").alias("n"), F.max_by("verdict", F.struct("v", "verdict")).alias("top"), F.max("v").alias("m"))
    med = opinions.groupBy(key).agg(F.median("score").alias("median_score"))
    won = F.col("m") * 2 > F.col("n")
    return top.join(med, key).select(key, "n", F.when(won, F.col("top")).alias("verdict"), F.round("median_score", 4).alias("median_score"), (~won).alias("held"))


def consolidate(findings: DataFrame, key: str, order: list) -> DataFrame:
    """The first finding of each key by `order`, and how many it stands for; by a minimum of structs, without a sort."""
    best = findings.groupBy(key).agg(F.min(F.struct(*order, *(c for c in findings.columns if c != key))).alias("b"), F.count("*").alias("n_folded"))
    return best.select(key, *(F.col(f"b.{c}").alias(c) for c in findings.columns if c != key), "n_folded")


def split_leaks(items: DataFrame, key: str, split: str) -> DataFrame:
    """(key, n_splits) of keys that more than one split holds."""
    return items.groupBy(key).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def top_per_group(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def modal_outliers(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, usual, outliers, suspicious): the commonest value per key (the least of several) and the rows that depart from it.

    Departures are suspicious where they are few: two, or a quarter of at least three rows. Null values are a value.
    """
    k = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    m = k.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("usual"), F.sum("n").alias("n"), F.max("n").alias("_common"))
    out = F.col("n") - F.col("_common")
    return m.select(key, "n", "usual", out.alias("outliers"), ((F.col("n") >= 3) & (out > 0) & (out <= F.greatest(F.lit(2), F.floor(F.col("n") / 4)))).alias("suspicious"))
