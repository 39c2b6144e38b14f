"""Arithmetic over tables: stated totals and subtotals against the rows they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Labels of total rows and of subtotal rows.
TOTAL = r"(?i)^\s*(grand )?total\b|^\s*(합계|총계)"
SUBTOTAL = r"(?i)^\s*sub-?total\b|^\s*소계"


def total_rows(cells: DataFrame, table: str, row: str, label: str, value: str) -> DataFrame:
    """(table, row, kind, stated, computed, ok) for each total and subtotal row of cells(table, row, label, value).

    A subtotal stands for the rows after the last subtotal or total, a total for all rows after the last total; subtotals
    count in neither. Null values add nothing; a total without rows before it is computed as 0.
    """
    kind = F.when(F.col(label).rlike(SUBTOTAL), "SUBTOTAL").when(F.col(label).rlike(TOTAL), "TOTAL")
    w = W.partitionBy(table).orderBy(row)
    c = cells.withColumn("_kind", kind).withColumn("_plain", F.when(F.col("_kind").isNull(), F.col(value)))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("_t", F.coalesce(F.count_if(F.col("_kind") == "TOTAL").over(before), F.lit(0))).withColumn("_s", F.coalesce(F.count_if(F.col("_kind").isNotNull()).over(before), F.lit(0)))
    over = lambda *by: F.sum("_plain").over(W.partitionBy(table, *by))
    c = c.withColumn("_sub", over("_s")).withColumn("_all", over("_t"))
    computed = F.coalesce(F.when(F.col("_kind") == "SUBTOTAL", F.col("_sub")).otherwise(F.col("_all")), F.lit(0))
    return c.filter("_kind is not null").select(table, row, F.col("_kind").alias("kind"), F.col(value).alias("stated"), computed.alias("computed"), F.col(value).eqNullSafe(computed).alias("ok"))
