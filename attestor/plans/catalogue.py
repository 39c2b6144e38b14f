"""All registered queries of the library and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import rules, scoring, text

MODULES = ("text", "rules", "joins", "scoring", "arithmetic", "evaluation", "retrieval", "extraction", "legal", "review", "formats")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _r = import_module(f"attestor.plans.{_name}").R
    QUERIES.update(_r.queries)
    ORACLE_SQL.update(_r.sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to blocks to rule findings to a capped risk index and gate per document, beside the quality label."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = rules.rule_findings(text.blocks(docs), "doc_id", "block_no")
    risk = found.groupBy("doc_id").agg(F.least(F.lit(100.0), F.sum(F.col("weight") * F.least("hits", F.lit(5)))).alias("risk"), F.countDistinct("rule_id").alias("n_rules"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = docs.select("doc_id").join(risk, "doc_id", "left").join(labels, "doc_id", "left")
    risk = F.round(F.coalesce("risk", F.lit(0.0)), 4)
    return out.select("doc_id", risk.alias("risk"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"), scoring.gate(risk, F.lit(False), F.lit(0)).alias("gate"), "quality")


def _flagship_sql() -> str:
    from .rules import FOUND_SQL

    return FOUND_SQL + """, r AS (SELECT doc_id, least(100.0, sum(weight * least(hits, 5))) AS risk, count(DISTINCT rule_id) AS n_rules FROM f GROUP BY 1),
x AS (SELECT doc_id, round(coalesce(risk, 0), 4)::DOUBLE AS risk, coalesce(n_rules, 0) AS n_rules, quality FROM documents LEFT JOIN r USING (doc_id) LEFT JOIN labels USING (doc_id))
SELECT doc_id, risk, n_rules, CASE WHEN risk >= 70 THEN 'BLOCK' WHEN risk >= 40 THEN 'REVIEW' WHEN risk >= 1 THEN 'CAUTION' ELSE 'PASS' END AS gate, quality FROM x"""


QUERIES["document_risk"] = flagship
ORACLE_SQL["document_risk"] = _flagship_sql()
