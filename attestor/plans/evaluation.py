"""Queries of evaluation, audit and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import audit, evaluation as ops, scoring

from ._base import EVENT_K, Registry, table

R = Registry()

GOLD = """gold AS (SELECT doc_id, 'low' AS label FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
found AS (SELECT doc_id, 'low' AS label FROM documents JOIN labels USING (doc_id) WHERE contains(text, '%%%') OR contains(text, ' | ') OR contains(text, '!!') UNION ALL SELECT doc_id, 'toxic' FROM documents JOIN labels USING (doc_id) WHERE regexp_matches(text, '(idiot|moron|stupid|trash)'))"""


def gold_found(spark, d):
    g = table(spark, d, "labels")
    gold = g.filter("quality = 0").select("doc_id", F.lit("low").alias("label")).unionByName(g.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("label")))
    t = table(spark, d, "documents").select("doc_id", "text").join(g.select("doc_id"), "doc_id")
    low = F.col("text").contains("%%%") | F.col("text").contains(" | ") | F.col("text").contains("!!")
    tags = F.filter(F.array(F.when(low, F.lit("low")), F.when(F.col("text").rlike("(idiot|moron|stupid|trash)"), F.lit("toxic"))), lambda x: x.isNotNull())
    return gold, t.select("doc_id", F.explode(tags).alias("label"))


PRF = f"""WITH {GOLD}, j AS (SELECT coalesce(g.label, f.label) AS label, g.doc_id IS NOT NULL AS g, f.doc_id IS NOT NULL AS f FROM gold g FULL JOIN found f ON g.doc_id = f.doc_id AND g.label = f.label),
c AS (SELECT label, count(*) FILTER (WHERE g AND f) AS tp, count(*) FILTER (WHERE NOT g) AS fp, count(*) FILTER (WHERE NOT f) AS fn FROM j GROUP BY 1)"""


@R.add(PRF + " SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM c")
def prf_by_error(spark, d):
    gold, found = gold_found(spark, d)
    return ops.prf(gold, found, ["doc_id"])


Z = "1.959963984540054"


@R.add(f"""WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY 1), p AS (SELECT *, k / n AS p FROM c)
SELECT source, n, k, round(greatest(0.0, (p + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) - {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n)) / (1 + {Z} * {Z} / n)), 6)::DOUBLE AS lower,
round(least(1.0, (p + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) + {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n)) / (1 + {Z} * {Z} / n)), 6)::DOUBLE AS upper FROM p""")
def wilson(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    lo, hi = ops.wilson(F.col("k"), F.col("n"))
    return j.select("source", "n", "k", lo.alias("lower"), hi.alias("upper"))


@R.add("SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(sum(value), 2) AS total FROM events GROUP BY 1")
def resource_percentiles(spark, d):
    return ops.percentiles(table(spark, d, "events"), "event_type", "value")


@R.add("""WITH c AS (SELECT event_id, event_type, value AS c FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id, value * 0.9::DOUBLE AS b FROM events WHERE event_id % 2 = 0)
SELECT event_type, count(b) AS n, round(avg(c - b), 4) AS mean_delta, round(quantile_cont(c - b, 0.5), 4) AS median_delta, round(avg(c - b) / avg(b), 4) AS relative_delta, count(*) - count(b) AS missing FROM c LEFT JOIN b USING (event_id) GROUP BY 1""")
def paired_deltas(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return ops.paired_deltas(e.filter("event_id % 3 <> 0"), e.filter("event_id % 2 = 0").withColumn("value", F.col("value") * 0.9), "event_id", "event_type", "value")


@R.add("WITH k AS (SELECT md5(text) AS key, CASE doc_id % 10 WHEN 0 THEN 'TEST' WHEN 1 THEN 'VALIDATION' ELSE 'DEVELOPMENT' END AS split FROM documents) SELECT key, count(DISTINCT split) AS n_splits FROM k GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leak_guard(spark, d):
    split = F.when(F.col("doc_id") % 10 == 0, "TEST").when(F.col("doc_id") % 10 == 1, "VALIDATION").otherwise("DEVELOPMENT")
    return scoring.split_leaks(table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("key"), split.alias("split")), "key", "split")


DRAWS = """f AS (SELECT source AS family, count(*) AS n, sum(quality) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY 1), r AS (SELECT unnest(range(200)) AS draw),
u AS (SELECT draw, n, hits, ('0x' || substr(md5('1|' || draw || CASE WHEN family IS NULL THEN '' ELSE '|' || family END), 1, 7))::BIGINT % 10000 / 10000.0::DOUBLE AS u FROM f, r),
w AS (SELECT *, CASE WHEN u < 0.3679 THEN 0 WHEN u < 0.7358 THEN 1 WHEN u < 0.9197 THEN 2 ELSE 3 END AS w FROM u), s AS (SELECT draw::INT AS draw, round(sum(w * hits) / nullif(sum(w * n), 0)::DOUBLE, 6) AS share FROM w GROUP BY 1)"""


def draws(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.col("source").alias("family")).join(table(spark, d, "labels"), "doc_id").groupBy("family").agg(F.count("*").alias("n"), F.sum("quality").alias("hits"))
    return ops.bootstrap(f, 200, "hits", "n")


@R.add(f"WITH {DRAWS} SELECT draw, share FROM s")
def bootstrap_hash(spark, d):
    return draws(spark, d)


@R.add(f"WITH {DRAWS} SELECT round(quantile_cont(share, 0.025), 6) AS lower, round(quantile_cont(share, 0.975), 6) AS upper, count(share) AS valid FROM s")
def bootstrap_interval(spark, d):
    return ops.bootstrap_interval(draws(spark, d))


@R.add("""WITH g AS (SELECT doc_id, lang, CASE WHEN quality = 1 THEN 'VERIFIED' ELSE 'CONTRADICTED' END AS g FROM documents JOIN labels USING (doc_id)),
f AS (SELECT doc_id, CASE WHEN contains(text, '%%%') THEN 'CONTRADICTED' WHEN contains(text, ' | ') THEN 'ABSTAIN' ELSE 'VERIFIED' END AS f FROM documents WHERE doc_id % 10 <> 3),
c AS (SELECT lang, count(*) AS items, count(*) FILTER (WHERE f = 'VERIFIED') AS verified, count(*) FILTER (WHERE f = 'VERIFIED' AND g <> 'VERIFIED') AS false_verified, count(*) FILTER (WHERE f IN ('VERIFIED', 'CONTRADICTED')) AS decided, count(*) FILTER (WHERE f IS NULL) AS missing FROM g LEFT JOIN f USING (doc_id) GROUP BY 1)
SELECT lang, items, verified, false_verified, round(false_verified / nullif(verified, 0), 4) AS false_verified_rate, round(decided / items, 4) AS coverage, missing FROM c""")
def status_rates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    gold = docs.select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", F.when(F.col("quality") == 1, "VERIFIED").otherwise("CONTRADICTED").alias("status"))
    said = F.when(F.col("text").contains("%%%"), "CONTRADICTED").when(F.col("text").contains(" | "), "ABSTAIN").otherwise("VERIFIED")
    return ops.status_rates(gold, docs.filter("doc_id % 10 <> 3").select("doc_id", said.alias("status")), "doc_id", "lang")


@R.add("""WITH l AS (SELECT doc_id, quality FROM labels), d AS (SELECT doc_id FROM documents) SELECT count(*) AS n, count(quality) AS assessed, count(*) - count(quality) AS abstained, round(count(quality) / count(*), 4) AS coverage FROM d LEFT JOIN l USING (doc_id)""")
def coverage_abstention(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.agg(F.count("*").alias("n"), F.count("quality").alias("assessed"), (F.count("*") - F.count("quality")).alias("abstained"), F.round(F.count("quality") / F.count("*"), 4).alias("coverage"))


@R.add(None)
def bipartite_match(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("right")).distinct()
    return ops.bipartite_matching(e, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("size"))


# Links are made one after another, then some are forged; each is checked against the stored one before it.
CHAIN = """b AS (SELECT user_id, event_id, event_type || ':' || event_id AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT user_id, n, event_id, body, sha256(body) AS good FROM b WHERE n = 1 UNION ALL SELECT b.user_id, b.n, b.event_id, b.body, sha256(c.good || b.body) FROM c JOIN b ON b.user_id = c.user_id AND b.n = c.n + 1),
l AS (SELECT user_id, event_id, body, CASE WHEN event_id % 97 = 0 THEN sha256('forged') ELSE good END AS link FROM c),
s AS (SELECT *, sha256(coalesce(lag(link) OVER (PARTITION BY user_id ORDER BY event_id), '') || body) AS again FROM l)"""


@R.add(f"WITH RECURSIVE {CHAIN} SELECT user_id, count(*) AS n, min(CASE WHEN link <> again THEN event_id END) AS first_broken, arg_max(link, event_id) AS head FROM s GROUP BY 1")
def hash_chain_verify(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("body"))
    s = audit.chain(e, "user_id", "event_id", "body").withColumn("link", F.when(F.col("event_id") % 97 == 0, F.sha2(F.lit("forged").cast("binary"), 256)).otherwise(F.col("link")))
    return audit.verify_chain(s, "user_id", "event_id", "body")


@R.add(f"""WITH m AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN -2 ELSE 1 END * {EVENT_K} AS u FROM events), r AS (SELECT *, sum(u) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
SELECT user_id, count(*) AS n, arg_max(run, event_id)::BIGINT AS balance, max(run)::BIGINT AS peak, min(CASE WHEN run > 100 THEN event_id END) AS first_breach FROM r GROUP BY 1""")
def ledger_balance(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    m = table(spark, d, "events").select("user_id", "event_id", (F.when(F.col("event_type") == "purchase", -2).otherwise(1) * k).alias("u"))
    return audit.ledger(m, "user_id", "event_id", "u", 100)


@R.add("""WITH w AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, event_id, event_type FROM w WHERE n = 1 OR event_type IS DISTINCT FROM p""")
def progress_changes(spark, d):
    return audit.changes(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@R.add("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY 1, 2""")
def lease_sessions(spark, d):
    return audit.leases(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", 12 * 3600)
