"""Queries of the join-shaped operators, on orders, line items, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import joins as ops, text as text_ops
from attestor.session import ensure_checkpoint_dir

from ._base import BLOCKS, EVENT_K, Registry, table

R = Registry()


@R.add("""WITH l AS (SELECT DISTINCT l_partkey + CASE WHEN l_partkey % 7 = 0 THEN 100000 ELSE 0 END AS k, CASE WHEN l_partkey % 5 = 0 THEN 'Brand#00' END AS brand FROM lineitem),
r AS (SELECT p_partkey AS k, p_brand FROM part UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_partkey % 11 = 0),
g AS (SELECT k, count(*) AS n, min(p_brand) AS b FROM r GROUP BY 1)
SELECT k, brand, coalesce(n, 0) AS n_found, CASE WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' WHEN brand IS NULL OR brand = b THEN 'MATCH' ELSE 'METADATA_MISMATCH' END AS status FROM l LEFT JOIN g USING (k)""")
def lookup_match_status(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_partkey") + F.when(F.col("l_partkey") % 7 == 0, 100000).otherwise(0)).alias("k"), F.when(F.col("l_partkey") % 5 == 0, "Brand#00").alias("brand")).distinct()
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    return ops.lookup_status(l, p.unionByName(p.filter("k % 11 = 0")), "k", {"brand": "p_brand"})


@R.add("""SELECT o_orderkey, field, stated, official FROM (SELECT o_orderkey, 'status' AS field, o_orderstatus AS stated, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS official FROM orders
UNION ALL SELECT o_orderkey, 'customer', o_custkey::VARCHAR, CASE WHEN o_orderkey % 10 = 0 THEN (o_custkey + 1)::VARCHAR ELSE o_custkey::VARCHAR END FROM orders) WHERE stated <> official""")
def metadata_compare(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    official = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")).alias("s"), (F.col("o_custkey") + (F.col("o_orderkey") % 10 == 0).cast("int")).alias("c"))
    return ops.mismatch_rows(o, official, "o_orderkey", {"status": (F.col("o_orderstatus"), F.col("s")), "customer": (F.col("o_custkey"), F.col("c"))})


@R.add("""WITH v AS (SELECT o_custkey AS k, o_orderdate AS since, count(*) AS n, min({'o_orderkey': o_orderkey}) AS p FROM orders GROUP BY 1, 2),
f AS (SELECT DISTINCT l_suppkey AS k, l_shipdate AS shipped FROM lineitem),
j AS (SELECT f.k, f.shipped, v.since, v.n, v.p FROM f ASOF LEFT JOIN v ON f.k = v.k AND f.shipped >= v.since)
SELECT k, shipped, since AS effective_from, p.o_orderkey AS o_orderkey, CASE WHEN k NOT IN (SELECT o_custkey FROM orders) THEN 'UNKNOWN' WHEN since IS NULL THEN 'BEFORE_FIRST' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS status FROM j""")
def asof_version(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("shipped")).distinct()
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("since"), "o_orderkey")
    return ops.as_of(f, v, "k", "shipped", "since", ["o_orderkey"])


@R.add("SELECT o_custkey, o_orderdate, o_orderkey, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS effective_until FROM orders")
def effective_until(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return o.withColumn("effective_until", F.lead("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))


RANGES = """r AS (SELECT s_suppkey AS k, s_suppkey * 10 AS ref, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (s_suppkey % 100) AS low, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE TIMESTAMP '1997-06-01' END AS high FROM supplier
UNION ALL SELECT s_suppkey, s_suppkey * 10 + 1, TIMESTAMP '1996-06-01', TIMESTAMP '1998-01-01' FROM supplier WHERE s_suppkey % 3 = 0)"""


@R.add(f"""WITH {RANGES}, f AS (SELECT DISTINCT l_suppkey AS k, l_shipdate AS shipped FROM lineitem)
SELECT f.k, shipped, count(low) AS n_found, CASE WHEN count(low) = 1 THEN min(ref) END AS ref, CASE count(low) WHEN 0 THEN 'NONE' WHEN 1 THEN 'FOUND' ELSE 'UNRESOLVED' END AS status
FROM f LEFT JOIN r ON f.k = r.k AND shipped >= low AND (high IS NULL OR shipped <= high) GROUP BY 1, 2""")
def interval_lookup(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    day = F.expr("timestamp_ntz'1995-01-01' + make_dt_interval(int(k % 100))")
    r = s.select("k", (F.col("k") * 10).alias("ref"), day.alias("low"), F.when(F.col("k") % 4 != 0, F.expr("timestamp_ntz'1997-06-01'")).alias("high"))
    r = r.unionByName(s.filter("k % 3 = 0").select("k", (F.col("k") * 10 + 1).alias("ref"), F.expr("timestamp_ntz'1996-06-01'").alias("low"), F.expr("timestamp_ntz'1998-01-01'").alias("high")))
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("shipped")).distinct()
    return ops.interval_lookup(f, r, "k", "shipped", "low", "high", "ref")


@R.add("""WITH o(first, "then") AS (VALUES ('view', 'purchase'), ('login', 'click'), ('signup', 'purchase')),
last AS (SELECT user_id, event_type AS first, max(ts) AS last_at FROM events GROUP BY 1, 2)
SELECT e.user_id, o.first, o."then", count(*) AS n FROM events e JOIN o ON e.event_type = o."then" JOIN last l ON l.user_id = e.user_id AND l.first = o.first WHERE e.ts < l.last_at GROUP BY 1, 2, 3""")
def timeline_inversions(spark, d):
    order = spark.createDataFrame([("view", "purchase"), ("login", "click"), ("signup", "purchase")], "first string, then string")
    return ops.inversions(table(spark, d, "events"), order, "user_id", "event_type", "ts")


@R.add(f"""WITH f AS (SELECT user_id, event_type, {EVENT_K} AS k, event_id % 5 AS doc, round(value) AS v FROM events)
SELECT user_id, event_type, count(DISTINCT doc) AS n_documents, count(DISTINCT v) AS n_values, min(v) AS low, max(v) AS high FROM f WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT doc) > 1 AND count(DISTINCT v) > 1""")
def cross_doc_contradictions(spark, d):
    f = table(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 5).alias("doc"), F.round("value").alias("v"))
    return ops.contradictions(f, ["user_id", "event_type"], "doc", "v")


@R.add("""WITH s AS (SELECT l_partkey, l_suppkey % 3 AS doc, list_sort(list(DISTINCT l_returnflag)) AS s FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, count(*) AS n_documents, count(DISTINCT s) AS n_sets FROM s GROUP BY 1 HAVING count(DISTINCT s) > 1""")
def value_set_compare(spark, d):
    f = table(spark, d, "lineitem").withColumn("doc", F.col("l_suppkey") % 3)
    return ops.value_set_conflicts(f, "l_partkey", "doc", "l_returnflag")


@R.add("""WITH o AS (SELECT l_partkey, l_suppkey, min(l_linestatus) AS v FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linestatus) = 1)
SELECT l_partkey, count(DISTINCT v) AS n_values FROM o GROUP BY 1 HAVING count(DISTINCT v) > 1""")
def fact_store_compare(spark, d):
    return ops.single_value_conflicts(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_linestatus")


@R.add("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_missing_refs(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@R.add("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def access_scope(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@R.add("""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)), l AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (FROM o))
SELECT 'customer' AS tab, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""")
def purge_cascade(spark, d):
    c = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").join(c, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    l = table(spark, d, "lineitem").join(o, "l_orderkey", "left_semi")
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("tab"), "n")
    return count(c, "customer").unionByName(count(o, "orders")).unionByName(count(l, "lineitem"))


@R.add("""WITH g AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS active, max(o_orderdate) AS newest, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, c_name, active::BIGINT AS active, newest, n FROM g JOIN customer ON c_custkey = o_custkey ORDER BY active DESC, newest DESC, c_custkey LIMIT 50""")
def runs_by_project(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("active"), F.max("o_orderdate").alias("newest"), F.count("*").alias("n"))
    return g.join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").orderBy(F.desc("active"), F.desc("newest"), "c_custkey").limit(50)


@R.add("""WITH g AS (SELECT md5(text) AS digest, length(text) AS size, doc_id, source FROM documents),
w AS (SELECT *, count(*) OVER (PARTITION BY digest, size) AS n_copies, row_number() OVER (PARTITION BY digest, size ORDER BY source, doc_id) AS rank FROM g)
SELECT digest, doc_id, size::BIGINT AS size, n_copies, rank::INT AS rank FROM w WHERE n_copies > 1""")
def duplicate_groups(spark, d):
    f = table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("size"), "doc_id", "source")
    return ops.duplicate_groups(f, ["digest", "size"], ["source", "doc_id"]).drop("source")


COPY = f"""{BLOCKS}, u AS (SELECT text, min({{'doc_id': doc_id, 'block_no': block_no}}) AS id, min(doc_id) AS lo, max(doc_id) AS hi, count(DISTINCT doc_id) AS docs FROM blocks WHERE length(text) >= 30 GROUP BY 1),
v AS (SELECT *, list_distinct([substr(text, i, 5) FOR i IN range(1, length(text) - 3)]) AS s, list_distinct([substr(text, i, 8) FOR i IN range(1, length(text) - 6)]) AS s8 FROM u),
g AS (SELECT id, len(s) AS n, unnest(s) AS g FROM v), f AS (SELECT g, count(*) AS df FROM g GROUP BY 1), r AS (SELECT id, n, g, df, row_number() OVER (PARTITION BY id ORDER BY df, g) AS r FROM g JOIN f USING (g)),
c AS (SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM r x JOIN r y ON x.g = y.g AND x.id <> y.id AND x.n <= y.n WHERE x.df > 1 AND x.r <= floor(0.1 * x.n + 1e-9) + 1),
p AS (SELECT x.id AS a, y.id AS b, x.docs AS a_docs, y.docs AS b_docs, len(list_intersect(x.s8, y.s8)) AS shared, len(list_intersect(x.s, y.s)) / least(len(x.s), len(y.s)) AS o FROM c JOIN v x ON x.id = a JOIN v y ON y.id = b WHERE NOT (x.lo = y.lo AND x.hi = y.hi AND x.lo = x.hi)),
o AS (SELECT * FROM p WHERE o >= 0.9 AND shared >= 3 UNION ALL SELECT id, id, docs, docs, len(s8), 1.0 FROM v WHERE docs > 1)"""


@R.add(f"WITH {COPY} SELECT a.doc_id AS a_doc, a.block_no AS a_block, b.doc_id AS b_doc, b.block_no AS b_block, a_docs, b_docs, shared, round(o, 4) AS overlap FROM o")
def copied_sentences(spark, d):
    return ops.copied_units(text_ops.blocks(table(spark, d, "documents")).select("doc_id", "block_no", "text"))


@R.add("SELECT item_id, doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text)")
def benchmark_contained(spark, d):
    return ops.contained(table(spark, d, "documents"), table(spark, d, "benchmark"))


# No SQL: a recursive walk over all lines is too slow there; the operator is tested against brute force.
@R.add(None)
def entity_components(spark, d):
    ensure_checkpoint_dir(spark)
    # Orders are even nodes, parts odd ones.
    return ops.components(table(spark, d, "lineitem").select((2 * F.col("l_orderkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b")))


@R.add("""WITH v AS (SELECT l_orderkey, l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 13 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey % 17 <> 0 GROUP BY ALL)
SELECT coalesce(v.l_returnflag, w.l_returnflag) AS flag, CASE WHEN v.n IS NULL THEN 'ADDED' WHEN w.n IS NULL THEN 'REMOVED' WHEN v.n <> w.n THEN 'CHANGED' ELSE 'SAME' END AS change, count(*) AS n
FROM v FULL JOIN w ON v.l_orderkey = w.l_orderkey AND v.l_partkey = w.l_partkey AND v.l_returnflag = w.l_returnflag GROUP BY 1, 2""")
def version_diff(spark, d):
    l = table(spark, d, "lineitem")
    k = ["l_orderkey", "l_partkey", "l_returnflag"]
    v = l.groupBy(*k).agg(F.count("*").alias("n"))
    w = l.filter("l_partkey % 17 <> 0").withColumn("l_returnflag", F.when(F.col("l_partkey") % 13 == 0, "X").otherwise(F.col("l_returnflag"))).groupBy(*k).agg(F.count("*").alias("m"))
    change = F.when(F.col("n").isNull(), "ADDED").when(F.col("m").isNull(), "REMOVED").when(F.col("n") != F.col("m"), "CHANGED").otherwise("SAME")
    return v.join(w, k, "full_outer").groupBy(F.col("l_returnflag").alias("flag"), change.alias("change")).agg(F.count("*").alias("n"))


@R.add("""WITH m AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS seen FROM orders GROUP BY 1), w AS (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW']) AS p)
SELECT o_custkey, p AS missing FROM m, w WHERE NOT list_contains(seen, p)""")
def attachments_reconcile(spark, d):
    want = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    m = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("seen"))
    return m.select("o_custkey", F.explode(F.array_except(want, "seen")).alias("missing"))


@R.add("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'FORMAT_ERROR' WHEN doc_id % 3 = 1 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM documents""")
def hash_check(spark, d):
    t = table(spark, d, "documents")
    real = F.sha2(F.col("text").cast("binary"), 256)
    stated = F.when(F.col("doc_id") % 3 == 0, F.substring(real, 1, 40)).when(F.col("doc_id") % 3 == 1, F.upper(real)).otherwise(F.sha2(F.lit("x"), 256))
    ok = (F.length(stated) == 64) & stated.rlike("^[0-9A-Fa-f]+$")
    return t.select("doc_id", F.when(~ok, "FORMAT_ERROR").when(F.lower(stated) == real, "MATCH").otherwise("MISMATCH").alias("status"))


@R.add("""WITH t AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS stated FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS claimed, stated FROM orders JOIN t ON o_orderkey = l_orderkey WHERE stated <> o_totalprice::DECIMAL(18,2))
SELECT o_orderkey, claimed::DOUBLE AS claimed, stated::DOUBLE AS stated, list_sort(string_split(claimed::VARCHAR, '')) = list_sort(string_split(stated::VARCHAR, '')) AS same_digits FROM x""")
def statement_vs_claim(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("stated"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("claimed")).join(t, "o_orderkey").filter("claimed <> stated")
    digits = lambda c: F.array_sort(F.split(F.col(c).cast("string"), ""))
    return o.select("o_orderkey", F.col("claimed").cast("double").alias("claimed"), F.col("stated").cast("double").alias("stated"), (digits("claimed") == digits("stated")).alias("same_digits"))


@R.add("""WITH c AS (SELECT DISTINCT conv_id, role FROM conversations), r AS (SELECT conv_id, list_sort(list(role)) AS roles FROM c GROUP BY 1) SELECT conv_id, array_to_string(roles, ',') AS roles, len(roles) AS n FROM r WHERE NOT list_contains(roles, 'system')""")
def conversation_roles(spark, d):
    r = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("r"))
    return r.filter(~F.array_contains("r", "system")).select("conv_id", F.array_join("r", ",").alias("roles"), F.size("r").cast("long").alias("n"))
