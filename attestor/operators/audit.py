"""Audit and state: hash chains, ledgers, progress, leases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _head(before, body):
    return F.sha2(F.concat(F.coalesce(before, F.lit("")), F.coalesce(body, F.lit(""))).cast("binary"), 256)


def chain(events: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """events with link: SHA-256 of the link before it and the row's body, from "" on, along `order` within `key`.

    A link needs the one before it, so each key is folded in order, row by row as its rows stream past; a null body is empty.
    """
    columns = events.columns

    def fold(batches):
        import hashlib

        import pyarrow as pa

        at, head = None, ""
        for batch in batches:
            keys, links = batch.column(columns.index(key)).to_pylist(), []
            for k, b in zip(keys, batch.column(columns.index(body)).to_pylist()):
                if not links and at is None or k != at[0]:
                    at, head = (k,), ""
                head = hashlib.sha256((head + (b or "")).encode()).hexdigest()
                links.append(head)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(links, pa.string())], names=[*columns, "link"])

    schema = ", ".join(f"`{c}` {t}" for c, t in events.dtypes) + ", link string"
    return events.repartition(key).sortWithinPartitions(key, order).mapInArrow(fold, schema)


def verify_chain(stored: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """(key, n, first_broken, head): each stored link checked against the stored link before it; null first_broken is an intact chain."""
    w = W.partitionBy(key).orderBy(order)
    s = stored.withColumn("_ok", F.col("link").eqNullSafe(_head(F.lag("link").over(w), F.col(body))))
    return s.groupBy(key).agg(F.count("*").alias("n"), F.min(F.when(~F.col("_ok"), F.col(order))).alias("first_broken"), F.max_by("link", order).alias("head"))


def ledger(moves: DataFrame, account: str, order: str, units: str, cap: float) -> DataFrame:
    """(account, n, balance, peak, first_breach): running sum of moves against a cap."""
    w = W.partitionBy(account).orderBy(order)
    r = moves.withColumn("run", F.sum(units).over(w))
    return r.groupBy(account).agg(F.count("*").alias("n"), F.max_by("run", order).alias("balance"), F.max("run").alias("peak"), F.min(F.when(F.col("run") > cap, F.col(order))).alias("first_breach"))


def changes(log: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before; the first row of a key counts."""
    w = W.partitionBy(key).orderBy(*order)
    return log.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_p"))).drop("_p", "_n")


def leases(log: DataFrame, key: str, at: str, timeout_s: int) -> DataFrame:
    """(key, session, n, started, ended): runs of events with gaps up to the timeout."""
    w = W.partitionBy(key).orderBy(at)
    gap = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) > timeout_s * 1_000_000, F.lit(True))
    s = log.withColumn("session", F.sum(gap.cast("int")).over(W.partitionBy(key).orderBy(at)))
    return s.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(at).alias("started"), F.max(at).alias("ended"))


def gaps(df: DataFrame, key: str, number: str, first: int | None = None) -> DataFrame:
    """(key, after, missing_from, missing_to): integers that a key's sequence skips, as ranges; `first` also counts before the least."""
    w = W.partitionBy(key).orderBy(number)
    d = df.select(key, F.col(number).cast("long").alias("n")).distinct().withColumn("p", F.lag("n").over(W.partitionBy(key).orderBy("n")))
    start = F.coalesce("p", F.lit(None if first is None else first - 1).cast("long"))
    return d.withColumn("after", start).filter(F.col("n") > F.col("after") + 1).select(key, "after", (F.col("after") + 1).alias("missing_from"), (F.col("n") - 1).alias("missing_to"))
