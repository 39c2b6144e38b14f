"""Evaluation: precision and recall, abstention, percentiles, intervals, paired deltas, bootstrap, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prf(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) over (keys, label) rows; null where the denominator is 0."""
    on = [*keys, "label"]
    j = gold.select(*on, F.lit(1).alias("g")).distinct().join(found.select(*on, F.lit(1).alias("f")).distinct(), on, "full_outer")
    c = j.groupBy("label").agg(F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    div = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("label", "tp", "fp", "fn", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper bound of a share at 95 %, within 0 and 1; null for no trials."""
    p = F.try_divide(hits.cast("double"), n.cast("double"))
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.round(F.greatest(F.lit(0.0), mid - half), 6), F.round(F.least(F.lit(1.0), mid + half), 6)


def percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, p50, p95, total), exact with linear interpolation."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.percentile(value, 0.5), 4).alias("p50"), F.round(F.percentile(value, 0.95), 4).alias("p95"), F.round(F.sum(value), 2).alias("total"))


def status_rates(gold: DataFrame, found: DataFrame, key: str, by: str, decisive: tuple[str, ...] = ("VERIFIED", "CONTRADICTED")) -> DataFrame:
    """(by, items, verified, false_verified, false_verified_rate, coverage, missing): found(key, status) against gold(key, by, status); an item without a finding abstains."""
    j = gold.select(key, by, F.col("status").alias("g")).join(found.select(key, F.col("status").alias("f")), key, "left")
    sure = F.coalesce(F.col("f") == "VERIFIED", F.lit(False))
    g = j.groupBy(by).agg(F.count("*").alias("items"), F.count_if(sure).alias("verified"), F.count_if(sure & (F.col("g") != "VERIFIED")).alias("false_verified"), F.count_if(F.col("f").isin(*decisive)).alias("decided"), F.count_if(F.col("f").isNull()).alias("missing"))
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 4)
    return g.select(by, "items", "verified", "false_verified", share("false_verified", "verified").alias("false_verified_rate"), share("decided", "items").alias("coverage"), "missing")


def paired_deltas(current: DataFrame, baseline: DataFrame, key: str, by: str, value: str) -> DataFrame:
    """(by, n, mean_delta, median_delta, relative_delta, missing): current less baseline over the items that both runs hold; missing ones have no baseline."""
    j = current.select(key, by, F.col(value).alias("c")).join(baseline.select(key, F.col(value).alias("b")), key, "left").withColumn("d", F.col("c") - F.col("b"))
    both = F.count("d")
    relative = F.round(F.try_divide(F.avg("d"), F.avg(F.when(F.col("d").isNotNull(), F.col("b")))), 4)
    return j.groupBy(by).agg(both.alias("n"), F.round(F.avg("d"), 4).alias("mean_delta"), F.round(F.percentile("d", 0.5), 4).alias("median_delta"), relative.alias("relative_delta"), (F.count("*") - both).alias("missing"))


def bootstrap(families: DataFrame, draws: int, hits: str, n: str, seed: int = 1) -> DataFrame:
    """(draw, share): resampled shares; how often a family counts in a draw comes from a hash, 0 to 3 times by a Poisson law."""
    d = families.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    digest = F.md5(F.concat_ws("|", F.lit(seed), "draw", "family").cast("binary"))
    u = F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % 10000 / 10000
    w = F.when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).otherwise(3)
    g = d.withColumn("w", w).groupBy("draw").agg(F.sum(F.col("w") * F.col(hits)).alias("h"), F.sum(F.col("w") * F.col(n)).alias("t"))
    return g.select("draw", F.round(F.try_divide(F.col("h").cast("double"), F.col("t").cast("double")), 6).alias("share"))


def bootstrap_interval(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """(lower, upper, valid): the percentile interval of bootstrap(); draws without trials do not count."""
    tail = (1 - level) / 2
    return draws.agg(F.round(F.percentile("share", tail), 6).alias("lower"), F.round(F.percentile("share", 1 - tail), 6).alias("upper"), F.count("share").alias("valid"))


def bipartite_matching(edges: DataFrame, group: str) -> DataFrame:
    """(group, left, right): a maximum matching per group by augmenting paths; groups are the edges of one document."""
    schema = edges.schema

    def match(key, table):
        import pyarrow as pa

        near: dict = {}
        for a, b in sorted(zip(table["left"].to_pylist(), table["right"].to_pylist())):
            near.setdefault(a, []).append(b)
        owner: dict = {}

        def grow(a, seen):
            for b in near[a]:
                if b not in seen:
                    seen.add(b)
                    if b not in owner or grow(owner[b], seen):
                        owner[b] = a
                        return True
            return False

        for a in near:
            grow(a, set())
        kind = lambda c: table.schema.field(c).type
        return pa.table({group: pa.array([key[0].as_py()] * len(owner), kind(group)), "left": pa.array(list(owner.values()), kind("left")), "right": pa.array(list(owner), kind("right"))})

    types = {f.name: f.dataType.simpleString() for f in schema}
    return edges.groupBy(group).applyInArrow(match, f"{group} {types[group]}, left {types['left']}, right {types['right']}")
