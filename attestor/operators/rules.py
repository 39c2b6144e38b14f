"""Rules as constants: literal patterns in one projection over the texts, spans, masks, weighted scores, checklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestor.functions import text as T

# Kinds of personal data and their patterns, in order of priority.
PII = {
    "email": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "card": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "phone": r"\b[0-9]{3}-[0-9]{3,4}-[0-9]{4}\b",
    "resident": r"\b[0-9]{6}-[1-8][0-9]{6}\b",
    "secret": r"\b(?:token|secret|password|key) *[=:] *\"?[A-Za-z0-9]{12,}",
}
# Text rules as (rule, pattern, weight, category).
RULES = (
    ("licence_line", "[Ll]icen[sc]ed? under", 1.0, "boilerplate"),
    ("shouting", "[A-Z]{4,}!!", 0.8, "noise"),
    ("symbol_tail", r"[a-z](%%%|&&&|\*\*\*|\$\$\$|###)", 1.2, "noise"),
    ("table_bars", r" \| .* \| ", 0.5, "layout"),
    ("secret", "(token|secret|password) *[=:]", 2.0, "privacy"),
    ("address", "@[a-z0-9-]+\\.", 1.5, "privacy"),
    ("draft", "(TODO|FIXME|DRAFT|lorem ipsum)", 2.0, "residue"),
    ("ignore_order", "(?i)ignore (all )?(previous|above) instructions", 3.0, "injection"),
)


def rule_findings(units: DataFrame, *keys: str, rules=RULES) -> DataFrame:
    """(keys, rule_id, category, weight, hits): each rule that matches a unit's text, in one pass; patterns are compiled once."""
    hits = (F.when(F.col("text").rlike(p), F.regexp_count("text", F.lit(p))).otherwise(0).cast("long") for _, p, _, _ in rules)
    found = F.array(*(F.struct(F.lit(r).alias("rule_id"), F.lit(c).alias("category"), F.lit(float(w)).alias("weight"), n.alias("hits")) for (r, _, w, c), n in zip(rules, hits)))
    return units.select(*keys, F.inline(found)).filter("hits > 0")


def pii_spans(docs: DataFrame, kinds=None) -> DataFrame:
    """(doc_id, kind, value, start, stop) of each match of each kind, every occurrence; covered spans are dropped.

    The places follow from the pieces between the matches, so the text itself never leaves its row.
    """
    kinds = kinds or PII

    def spans(kind, pattern):
        value = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        pair = F.zip_with(value, F.slice(F.split("text", pattern), 1, F.size(value)), lambda v, p: F.struct(v.alias("v"), F.length(p).alias("gap")))
        none = F.lit(None).cast("array<struct<kind:string,value:string,start:int,stop:int>>")

        def step(acc, x):
            start = acc["at"] + x["gap"]
            stop = start + F.length(x["v"])
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), x["v"].alias("value"), start.alias("start"), stop.alias("stop")))).alias("out"))

        empty = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<kind:string,value:string,start:int,stop:int>>)").alias("out"))
        return F.when(F.col("text").rlike(pattern), F.aggregate(pair, empty, step, lambda acc: acc["out"])).otherwise(none)

    found = F.array(*(spans(k, p) for k, p in kinds.items()))
    s = docs.select("doc_id", F.explode(F.flatten(F.filter(found, lambda x: x.isNotNull()))).alias("s")).select("doc_id", "s.*")
    from .text import cover_dedupe

    return cover_dedupe(s, "doc_id")


def mask_pii(text, kinds=None):
    """Text with each kind replaced by its bracketed name, in order of priority."""
    for k, p in (kinds or PII).items():
        text = F.regexp_replace(text, p, f"[{k}]")
    return text


def numbered(rows: DataFrame, group: list[str], block, order: list) -> DataFrame:
    """rows with number: 1, 2, ... along (block, order) within the group. Each block is ranked by itself; only counts per block run over a group."""
    b = rows.withColumn("_block", block)
    counts = b.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*(group or [F.lit(0)])).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    n = F.row_number().over(W.partitionBy(*group, "_block").orderBy(*order))
    return b.join(before, [*group, "_block"]).withColumn("number", F.col("_before") + n).drop("_block", "_before")


def pseudonyms(spans: DataFrame, block: int = 4096) -> DataFrame:
    """(kind, value, pseudonym): numbered per kind by first occurrence (doc_id, then place), `block` doc_ids at a time."""
    first = spans.groupBy("kind", "value").agg(F.min(F.struct("doc_id", "start")).alias("at"))
    n = numbered(first, ["kind"], F.floor(F.col("at.doc_id") / block), ["at", "value"])
    return n.select("kind", "value", F.concat(F.upper("kind"), F.lit("_"), F.lpad(F.col("number").cast("string"), 4, "0")).alias("pseudonym"))


def injection_class(findings: DataFrame, *keys: str) -> DataFrame:
    """(keys, score, n_rules, verdict): summed weights and the number of rules that corroborate each other."""
    g = findings.groupBy(*keys).agg(F.sum("weight").alias("s"), F.countDistinct("rule_id").alias("n_rules"))
    v = F.when((F.col("s") >= 3.0) & (F.col("n_rules") >= 2), "CONFIRMED").when((F.col("s") >= 2.0) & (F.col("n_rules") >= 1), "LIKELY").when(F.col("s") >= 0.8, "SUSPECT").otherwise("NONE")
    return g.select(*keys, F.round("s", 4).alias("score"), "n_rules", v.alias("verdict"))


def checklist_gaps(docs: DataFrame, items) -> DataFrame:
    """(doc_id, item): items (item, trigger, mention) whose trigger a document has and whose mention it lacks; patterns are literals."""
    missing = F.array(*(F.when(F.col("text").rlike(t) & ~F.col("text").rlike(m), F.lit(i)) for i, t, m in items))
    return docs.select("doc_id", F.explode(F.filter(missing, lambda x: x.isNotNull())).alias("item"))


def ratio_by_sentence(docs: DataFrame, pattern: str, least: int = 8) -> DataFrame:
    """(doc_id, n, n_hit, ratio): share of sentences that match, over documents with `least` sentences or more."""
    s = docs.select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    g = s.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("s").rlike(pattern)).alias("n_hit")).filter(F.col("n") >= least)
    return g.select("doc_id", "n", "n_hit", F.round(F.col("n_hit") / F.col("n"), 4).alias("ratio"))


def residue(findings: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, n_categories): documents whose findings span `least` categories or more."""
    return findings.groupBy("doc_id").agg(F.countDistinct("category").alias("n_categories")).filter(F.col("n_categories") >= least)
