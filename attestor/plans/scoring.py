"""Queries of scores, gates, votes, rollups and usage metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import rules, scoring as ops

from ._base import EVENT_K, Registry, table

R = Registry()

WEIGHTS = (("click", 2.0), ("view", 1.0), ("purchase", 6.0), ("login", 0.5), ("signup", 4.0), ("error", 8.0), ("logout", 0.25))
WEIGHT_SQL = "weights(type, weight) AS (VALUES " + ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in WEIGHTS) + ")"
FINDINGS_SQL = f"""findings AS (SELECT event_id, user_id, event_type AS type, {EVENT_K} % 7 AS citation, value, ['LOW','MEDIUM','HIGH','CRITICAL'][({EVENT_K} % 4) + 1] AS severity,
({EVENT_K} % 4) + 1 AS sev, {EVENT_K} % 13 = 0 AS hard, CASE WHEN event_id % 3 = 0 THEN 'VERIFIED' WHEN event_id % 3 = 1 THEN 'UNVERIFIED' ELSE 'FAILED' END AS status FROM events)"""


def findings(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    sev = F.array(*(F.lit(s) for s in ops.SEVERITIES))
    status = F.when(F.col("event_id") % 3 == 0, "VERIFIED").when(F.col("event_id") % 3 == 1, "UNVERIFIED").otherwise("FAILED")
    return table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("type"), (k % 7).alias("citation"), "value", F.get(sev, k % 4).alias("severity"), (k % 13 == 0).alias("hard"), status.alias("status"))


def weights(spark):
    return spark.createDataFrame(list(WEIGHTS), "type string, weight double")


RISK_SQL = f"""{FINDINGS_SQL}, {WEIGHT_SQL}, t AS (SELECT user_id, type, count(*) AS n FROM (SELECT DISTINCT user_id, type, citation FROM findings) GROUP BY 1, 2),
risk AS (SELECT user_id, least(100.0, sum(n * weight))::DOUBLE AS risk, count(*) AS n_types FROM t JOIN weights USING (type) GROUP BY 1)"""


@R.add(f"WITH {RISK_SQL} SELECT * FROM risk")
def risk_index(spark, d):
    return ops.risk_index(findings(spark, d), weights(spark), "user_id")


@R.add(f"""WITH {RISK_SQL}, f AS (SELECT user_id, bool_or(hard AND status = 'FAILED') AS hard, count(*) FILTER (WHERE status = 'UNVERIFIED') AS unverified FROM findings GROUP BY 1),
c AS (SELECT c_custkey AS user_id FROM customer)
SELECT user_id, CASE WHEN risk IS NULL THEN 'NOT_ASSESSED' WHEN hard OR risk >= 70 THEN 'BLOCK' WHEN risk >= 40 OR unverified > 0 THEN 'REVIEW' WHEN risk >= 1 THEN 'CAUTION' ELSE 'PASS' END AS gate FROM c LEFT JOIN risk USING (user_id) LEFT JOIN f USING (user_id)""")
def release_gate(spark, d):
    f = findings(spark, d)
    g = f.groupBy("user_id").agg(F.bool_or(F.col("hard") & (F.col("status") == "FAILED")).alias("hard"), F.count_if(F.col("status") == "UNVERIFIED").alias("unverified"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    j = c.join(ops.risk_index(f, weights(spark), "user_id"), "user_id", "left").join(g, "user_id", "left")
    return j.select("user_id", ops.gate(F.col("risk"), F.col("hard"), F.col("unverified")).alias("gate"))


@R.add(f"""WITH {FINDINGS_SQL} SELECT user_id, citation, count(*) AS n, ['LOW','MEDIUM','HIGH','CRITICAL'][max(sev)] AS worst, bool_or(hard) AS hard, min(type) AS first_type FROM findings GROUP BY 1, 2""")
def citation_groups(spark, d):
    f = findings(spark, d).withColumn("key", F.struct("user_id", "citation"))
    return ops.citation_groups(f, "key").select("key.user_id", "key.citation", "n", "worst", "hard", "first_type")


@R.add(f"""WITH {FINDINGS_SQL} SELECT severity, count(*) AS n, count(*) FILTER (WHERE status = 'VERIFIED') AS verified, count(*) FILTER (WHERE status = 'UNVERIFIED') AS unverified, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM findings GROUP BY 1""")
def severity_status_counts(spark, d):
    s = lambda x: F.count_if(F.col("status") == x)
    return findings(spark, d).groupBy("severity").agg(F.count("*").alias("n"), s("VERIFIED").alias("verified"), s("UNVERIFIED").alias("unverified"), s("FAILED").alias("failed"))


@R.add(f"""WITH {FINDINGS_SQL}, x AS (SELECT user_id, max(CASE WHEN type = 'click' THEN sev END) AS click, max(CASE WHEN type = 'purchase' THEN sev END) AS purchase, max(CASE WHEN type = 'view' THEN sev END) AS view FROM findings GROUP BY 1)
SELECT user_id, click, purchase, view, CASE WHEN click IS NULL AND purchase IS NULL AND view IS NULL THEN 'NOT_ASSESSED' WHEN greatest(click, purchase, view) >= 3 THEN 'ISSUES' ELSE 'CLEAR' END AS coverage FROM x""")
def axis_scores(spark, d):
    f = findings(spark, d).withColumn("sev", ops.rank(F.col("severity")))
    p = f.groupBy("user_id").agg(*(F.max(F.when(F.col("type") == t, F.col("sev"))).alias(t) for t in ("click", "purchase", "view")))
    c = F.when(F.coalesce("click", "purchase", "view").isNull(), "NOT_ASSESSED").when(F.greatest("click", "purchase", "view") >= 3, "ISSUES").otherwise("CLEAR")
    return p.withColumn("coverage", c)


@R.add("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 10) / 10 END AS a, (o_custkey % 11) / 10 AS b, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.7 ELSE 0.4 END::DOUBLE AS c FROM orders),
t AS (SELECT *, a * 0.5::DOUBLE + b * 0.3::DOUBLE + c * 0.2::DOUBLE AS t FROM x)
SELECT o_orderkey, round(t, 4) AS score, CASE WHEN a IS NULL THEN 'UNVERIFIABLE' WHEN a = 0 OR b = 0 THEN 'HARD_FAIL' WHEN a < 0.5 OR b < 0.5 OR c < 0.5 THEN 'WEAK' WHEN t >= 0.85 THEN 'STRONG' WHEN t >= 0.6 THEN 'FAIR' ELSE 'WEAK' END AS verdict FROM t""")
def claim_confidence(spark, d):
    o = table(spark, d, "orders")
    a = F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_orderkey") % 10) / 10)
    c = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.7).otherwise(0.4)
    score, verdict = ops.claim_confidence({"a": (F.col("a"), 0.5), "b": (F.col("b"), 0.3), "c": (F.col("c"), 0.2)})
    return o.select("o_orderkey", a.alias("a"), ((F.col("o_custkey") % 11) / 10).alias("b"), c.alias("c")).select("o_orderkey", score.alias("score"), verdict.alias("verdict"))


@R.add("""WITH w(feature, weight) AS (VALUES ('A', 0.05::DOUBLE), ('N', 0.02), ('R', -0.08)), f AS (SELECT l_orderkey, l_returnflag AS feature, count(*) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, round(least(0.99, greatest(0.05, 0.30 + sum(weight * least(v, 4)))), 4)::DOUBLE AS confidence FROM f JOIN w USING (feature) GROUP BY 1""")
def feature_confidence(spark, d):
    w = spark.createDataFrame([("A", 0.05), ("N", 0.02), ("R", -0.08)], "feature string, weight double")
    f = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("feature")).agg(F.count("*").alias("value"))
    return ops.feature_confidence(f, w, "l_orderkey")


@R.add("""WITH c AS (SELECT l_partkey, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT l_partkey, sum(n)::BIGINT AS n, max({'n': n, 'v': v}) AS top FROM c GROUP BY 1), m AS (SELECT l_partkey, median(l_discount) AS med FROM lineitem GROUP BY 1)
SELECT l_partkey, n, CASE WHEN top.n * 2 > n THEN top.v END AS verdict, round(med, 4) AS median_score, NOT top.n * 2 > n AS held FROM t JOIN m USING (l_partkey)""")
def majority_vote(spark, d):
    l = table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("verdict"), F.col("l_discount").alias("score"))
    return ops.majority_vote(l, "l_partkey")


@R.add("""WITH g AS (SELECT l_suppkey, l_partkey % 10 AS predicate, list_sort(list(DISTINCT l_shipdate::DATE::VARCHAR)) AS v FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_shipdate::DATE) >= 2)
SELECT 'CONF-' || lpad((row_number() OVER (ORDER BY l_suppkey, predicate))::VARCHAR, 6, '0') AS conflict_id, l_suppkey, predicate, len(v)::INT AS n_values, v[1] AS first_value FROM g""")
def conflict_sets(spark, d):
    l = table(spark, d, "lineitem")
    g = l.groupBy("l_suppkey", (F.col("l_partkey") % 10).alias("predicate")).agg(F.sort_array(F.collect_set(F.col("l_shipdate").cast("date").cast("string"))).alias("v")).filter(F.size("v") >= 2)
    # Numbers run over all suppliers: places within blocks of suppliers, after the counts of the blocks before.
    g = rules.numbered(g, [], F.floor(F.col("l_suppkey") / 4096), ["l_suppkey", "predicate"])
    return g.select(F.concat(F.lit("CONF-"), F.lpad(F.col("number").cast("string"), 6, "0")).alias("conflict_id"), "l_suppkey", "predicate", F.size("v").alias("n_values"), F.get("v", F.lit(0)).alias("first_value"))


@R.add("""SELECT c.c_nationkey, date_trunc('month', o.o_orderdate) AS month, count(DISTINCT o.o_orderkey) AS n_orders, count(*) AS n_lines, round(coalesce(sum(greatest(l.l_quantity - 5, 0)), 0), 2)::DOUBLE AS used, round(sum(l.l_quantity) / 1000, 4) AS quota
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2""")
def monthly_usage(spark, d):
    j = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey")
    # Lines are summed per order first; then nothing counts an order twice.
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(F.greatest(F.col("l_quantity") - 5, F.lit(0.0))).alias("u"), F.sum("l_quantity").alias("q"))
    g = j.join(l, "o_orderkey").groupBy("c_nationkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"))
    return g.agg(F.count("*").alias("n_orders"), F.sum("n").alias("n_lines"), F.round(F.coalesce(F.sum("u"), F.lit(0.0)), 2).alias("used"), F.round(F.sum("q") / 1000, 4).alias("quota"))


@R.add("""WITH m AS (SELECT unnest(generate_series(DATE '1994-01-01', DATE '1995-12-01', INTERVAL 1 MONTH))::DATE AS month), o AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT month, coalesce(n, 0) AS n, top FROM m LEFT JOIN o USING (month)""")
def dense_monthly_history(spark, d):
    m = spark.range(1).select(F.explode(F.sequence(F.lit("1994-01-01").cast("date"), F.lit("1995-12-01").cast("date"), F.expr("interval 1 month"))).alias("month"))
    o = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return m.join(o, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"), "top")


@R.add(f"""WITH {FINDINGS_SQL}, p AS (SELECT type, status, count(*) AS n FROM findings GROUP BY 1, 2)
SELECT type, sum(n)::BIGINT AS calls, sum(CASE WHEN status = 'VERIFIED' THEN n ELSE 0 END)::BIGINT AS ok, string_agg(status || '=' || n, ',' ORDER BY status) AS histogram FROM p GROUP BY 1""")
def provider_summary(spark, d):
    p = findings(spark, d).groupBy("type", "status").agg(F.count("*").alias("n"))
    h = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("status", "n"))), lambda x: F.concat(x["status"], F.lit("="), x["n"].cast("string"))), ",")
    return p.groupBy("type").agg(F.sum("n").alias("calls"), F.sum(F.when(F.col("status") == "VERIFIED", F.col("n")).otherwise(0)).alias("ok"), h.alias("histogram"))


@R.add(f"""WITH {FINDINGS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, citation ORDER BY sev DESC, event_id) AS rn, count(*) OVER (PARTITION BY user_id, citation) AS n_folded FROM findings)
SELECT user_id, citation, event_id, severity, n_folded FROM r WHERE rn = 1""")
def finding_consolidation(spark, d):
    f = findings(spark, d).select(F.struct("user_id", "citation").alias("key"), "event_id", "severity").withColumn("o", -ops.rank(F.col("severity")))
    best = f.groupBy("key").agg(F.min_by(F.struct("event_id", "severity"), F.struct("o", "event_id")).alias("b"), F.count("*").alias("n_folded"))
    return best.select("key.user_id", "key.citation", "b.event_id", "b.severity", "n_folded")


@R.add(f"""WITH {FINDINGS_SQL}, g AS (SELECT type, severity, count(*) AS n, count(*) FILTER (WHERE status <> 'UNVERIFIED') AS decided, count(*) FILTER (WHERE status = 'FAILED') AS fp FROM findings GROUP BY 1, 2)
SELECT type, severity, n, decided, CASE WHEN decided >= 5 THEN round(fp / decided, 4) END AS fp_rate FROM g""")
def feedback_rollup(spark, d):
    g = findings(spark, d).groupBy("type", "severity").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "UNVERIFIED").alias("decided"), F.count_if(F.col("status") == "FAILED").alias("fp"))
    return g.select("type", "severity", "n", "decided", F.when(F.col("decided") >= 5, F.round(F.col("fp") / F.col("decided"), 4)).alias("fp_rate"))


@R.add(f"""WITH {FINDINGS_SQL} SELECT date_trunc('week', ts)::TIMESTAMP AS week, status, count(*) AS n FROM findings JOIN events USING (event_id) GROUP BY 1, 2""")
def ticket_weeks(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return findings(spark, d).select("event_id", "status").join(e, "event_id").groupBy(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), "status").agg(F.count("*").alias("n"))


@R.add(f"""WITH {FINDINGS_SQL} SELECT event_id, user_id, type, severity FROM findings WHERE severity = 'HIGH' AND status = 'FAILED' AND citation IN (1, 3) ORDER BY sev DESC, event_id LIMIT 100""")
def findings_filter(spark, d):
    f = findings(spark, d).filter((F.col("severity") == "HIGH") & (F.col("status") == "FAILED") & F.col("citation").isin(1, 3))
    return f.orderBy(F.desc(ops.rank(F.col("severity"))), "event_id").limit(100).select("event_id", "user_id", "type", "severity")


@R.add(f"""WITH {FINDINGS_SQL} SELECT event_id, type, CASE WHEN hard THEN NULL ELSE round(value, 4) END AS excerpt FROM findings""")
def sealed_masking(spark, d):
    return findings(spark, d).select("event_id", "type", F.when(~F.col("hard"), F.round("value", 4)).alias("excerpt"))


@R.add("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn = 1""")
def latest_per_key(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return o.select("o_custkey", "m.o_orderkey", "m.o_orderdate")


@R.add("""SELECT p_type, p_brand, p_partkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3""")
def per_file_top3(spark, d):
    return ops.top_per_group(table(spark, d, "part"), ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_type", "p_brand", "p_partkey", "rank")


@R.add("""SELECT event_id, ts FROM events WHERE event_type = 'click' AND value > 10 AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 25""")
def due_queue(spark, d):
    e = table(spark, d, "events").filter((F.col("event_type") == "click") & (F.col("value") > 10) & (F.col("ts") <= F.lit("2024-01-20").cast("timestamp")))
    return e.orderBy("ts", "event_id").limit(25).select("event_id", "ts")
