"""Queries of arithmetic and calendar checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestor.functions import dates as D
from attestor.operators import arithmetic as ops, audit

from ._base import Registry, table

R = Registry()
MONEY = "decimal(18,2)"


@R.add("""WITH s AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS total, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, n, round(total::DOUBLE, 2) AS total, round(total::DOUBLE - o_totalprice, 2) AS diff, abs(total - o_totalprice::DECIMAL(18,2)) <= 0.01 AS ok, abs(total - total) <= 0.01 AS control FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def sum_check(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("total"), F.count("*").alias("n"))
    j = table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(s, "o_orderkey", "left")
    ok = F.abs(F.col("total") - F.col("o_totalprice").cast(MONEY)) <= 0.01
    return j.select("o_orderkey", "n", F.round(F.col("total").cast("double"), 2).alias("total"), F.round(F.col("total").cast("double") - F.col("o_totalprice"), 2).alias("diff"), ok.alias("ok"), (F.abs(F.col("total") - F.col("total")) <= 0.01).alias("control"))


@R.add("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS t FROM lineitem)
SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE abs(round(l_extendedprice / t * 100, 1) - l_extendedprice / t * 100) <= 0.04) AS within, round(max(l_extendedprice / t * 100), 4) AS top FROM x GROUP BY 1""")
def percent_check(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / F.sum("l_extendedprice").over(W.partitionBy("l_orderkey")) * 100).alias("p"))
    return x.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.abs(F.round("p", 1) - F.col("p")) <= 0.04).alias("within"), F.round(F.max("p"), 4).alias("top"))


@R.add("""WITH f AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS brk FROM events), g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f)
SELECT user_id, island::BIGINT AS island, count(*) AS n, round(sum(value), 4) AS total FROM g WHERE brk = 0 GROUP BY 1, 2 HAVING count(*) >= 2""")
def running_group_totals(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("brk", (F.col("event_type") == "purchase").cast("int")).withColumn("island", F.sum("brk").over(w)).filter("brk = 0")
    return e.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).filter("n >= 2")


PAIRS = "p AS (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate + INTERVAL 1 DAY * (o_custkey % 900))::DATE AS b, o_totalprice::DECIMAL(18,2) AS money FROM orders)"
MONTHS = "greatest(0, (year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN day(b) < least(day(a), day(last_day(b))) THEN 1 ELSE 0 END)"


def pairs(spark, d):
    a = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", a.alias("a"), F.date_add(a, (F.col("o_custkey") % 900).cast("int")).alias("b"), F.col("o_totalprice").cast(MONEY).alias("money"))


@R.add(f"WITH {PAIRS} SELECT o_orderkey, ({MONTHS})::INT AS months, (b - a + 1)::INT AS days_both, (b - a)::INT AS days_open FROM p")
def months_elapsed(spark, d):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, d).select("o_orderkey", D.months_elapsed(a, b).alias("months"), D.days_between(a, b).alias("days_both"), D.days_between(a, b, first=False).alias("days_open"))


@R.add(f"WITH {PAIRS} SELECT o_orderkey, (a + INTERVAL 14 MONTH)::DATE + 3 AS due, (a + INTERVAL 1 MONTH)::DATE AS next FROM p")
def add_period(spark, d):
    return pairs(spark, d).select("o_orderkey", D.add_period(F.col("a"), 1, 2, 3).alias("due"), D.add_period(F.col("a"), 0, 1).alias("next"))


@R.add(f"WITH {PAIRS}, m AS (SELECT *, {MONTHS} AS m FROM p) SELECT o_orderkey, m::INT AS months, CASE WHEN m < 6 THEN 0 WHEN m >= 24 THEN money::DOUBLE ELSE floor(money::DOUBLE * m / 24) END::DOUBLE AS vested FROM m")
def vesting(spark, d):
    p = pairs(spark, d).withColumn("m", D.months_elapsed(F.col("a"), F.col("b")))
    return p.select("o_orderkey", F.col("m").alias("months"), D.vested(F.col("money").cast("double"), F.col("m"), 6, 24).cast("double").alias("vested"))


@R.add(f"WITH {PAIRS} SELECT o_orderkey, round(money::DOUBLE * 0.05 * (b - a) / 365, 8) AS act365, round(money::DOUBLE * 0.05 * (b - a) / 360, 8) AS act360, round(money::DOUBLE * 0.12 * greatest(0, (b - a) - 30) / 365, 8) AS penalty FROM p")
def simple_interest(spark, d):
    days, m = F.datediff("b", "a"), F.col("money").cast("double")
    return pairs(spark, d).select("o_orderkey", F.round(D.simple_interest(m, F.lit(0.05), days), 8).alias("act365"), F.round(D.simple_interest(m, F.lit(0.05), days, 360), 8).alias("act360"), F.round(D.simple_interest(m, F.lit(0.12), F.greatest(days - 30, F.lit(0))), 8).alias("penalty"))


@R.add("""WITH e AS (SELECT o_custkey, o_orderdate::DATE AS day, sum(o_totalprice::DECIMAL(18,2)) AS paid FROM orders GROUP BY 1, 2),
r AS (SELECT *, sum(paid) OVER (PARTITION BY o_custkey ORDER BY day) AS balance, lead(day) OVER (PARTITION BY o_custkey ORDER BY day) AS until FROM e)
SELECT o_custkey, day, until, round(balance::DOUBLE, 2) AS balance, CASE WHEN until IS NOT NULL THEN round(balance::DOUBLE * CASE WHEN day < DATE '1995-01-01' THEN 0.05 ELSE 0.06 END * (until - day) / 365, 2) END AS accrued FROM r""")
def interest_schedule(spark, d):
    w = W.partitionBy("o_custkey").orderBy("day")
    e = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("paid"))
    r = e.withColumn("balance", F.sum("paid").over(w).cast("double")).withColumn("until", F.lead("day").over(w))
    rate = F.when(F.col("day") < F.lit("1995-01-01").cast("date"), 0.05).otherwise(0.06)
    return r.select("o_custkey", "day", "until", F.round("balance", 2).alias("balance"), F.when(F.col("until").isNotNull(), F.round(F.col("balance") * rate * F.datediff("until", "day") / 365, 2)).alias("accrued"))


@R.add(f"""WITH {PAIRS}, c AS (SELECT o_orderkey, money, a, b + s AS b2 FROM p, (VALUES (-30), (0), (30)) t(s)), o AS (SELECT o_orderkey, round(money::DOUBLE * 0.05 * greatest(0, b2 - a) / 365, 0) AS v FROM c)
SELECT o_orderkey, min(v) AS low, max(v) AS high, count(DISTINCT v) > 1 AS diverges FROM o GROUP BY 1""")
def sensitivity(spark, d):
    c = pairs(spark, d).withColumn("s", F.explode(F.array(F.lit(-30), F.lit(0), F.lit(30)))).withColumn("b2", F.date_add("b", F.col("s")))
    v = F.round(F.col("money").cast("double") * 0.05 * F.greatest(F.datediff("b2", "a"), F.lit(0)) / 365, 0)
    return c.select("o_orderkey", v.alias("v")).groupBy("o_orderkey").agg(F.min("v").alias("low"), F.max("v").alias("high"), (F.countDistinct("v") > 1).alias("diverges"))


@R.add("SELECT o_orderkey, ((isodow(o_orderdate) - 1) = o_orderkey % 7) AS weekday_ok, try_cast(year(o_orderdate) || '-02-' || (27 + o_orderkey % 5) AS DATE) AS february FROM orders")
def weekday_check(spark, d):
    day = F.col("o_orderdate").cast("date")
    text = F.concat(F.lit("due "), F.year(day).cast("string"), F.lit(".02."), (27 + F.col("o_orderkey") % 5).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", D.weekday_matches(day, F.col("o_orderkey") % 7).alias("weekday_ok"), D.parse_date(text).alias("february"))


@R.add("""WITH n AS (SELECT DISTINCT l_suppkey, l_partkey AS n FROM lineitem), p AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY l_suppkey ORDER BY n), 0) AS a FROM n)
SELECT l_suppkey, a AS after, a + 1 AS missing_from, n - 1 AS missing_to FROM p WHERE n > a + 1""")
def numbering_gaps(spark, d):
    return audit.gaps(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", first=1)


@R.add("""WITH v AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS yes, count(*) FILTER (WHERE l_returnflag = 'R') AS no FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, yes, no, CASE WHEN yes + no = 0 THEN NULL WHEN yes * 3 > n THEN TRUE WHEN (n - no) * 3 <= n THEN FALSE ELSE NULL END AS quorum FROM v""")
def quorum(spark, d):
    v = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("yes"), F.count_if(F.col("l_returnflag") == "R").alias("no"))
    return v.withColumn("quorum", F.when(F.col("yes") + F.col("no") == 0, F.lit(None)).when(F.col("yes") * 3 > F.col("n"), True).when((F.col("n") - F.col("no")) * 3 <= F.col("n"), False))


@R.add("SELECT l_orderkey, l_partkey, l_suppkey, round(floor(l_extendedprice::DECIMAL(18,4)), 0)::DOUBLE AS floor_, ceil(l_extendedprice::DECIMAL(18,4))::DOUBLE AS ceil_, round(l_extendedprice::DECIMAL(18,4), 0)::DOUBLE AS half_up, round(trunc(l_extendedprice::DECIMAL(18,4)), 0)::DOUBLE AS cut FROM lineitem")
def rounding_modes(spark, d):
    m = F.col("l_extendedprice").cast("decimal(18,4)")
    r = lambda k: D.round_mode(m, k).cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", r("FLOOR").alias("floor_"), r("CEIL").alias("ceil_"), r("HALF_UP").alias("half_up"), r("TRUNCATE").alias("cut"))


@R.add("""WITH c AS (SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross, l_discount, l_tax, l_extendedprice FROM lineitem)
SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE abs(gross - net * (1 + l_tax)) <= 0.0001) AS tax_ok, count(*) FILTER (WHERE net <= l_extendedprice) AS net_ok FROM c GROUP BY 1""")
def formula_check(spark, d):
    net, gross = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6)
    c = table(spark, d, "lineitem").select("l_orderkey", net.alias("net"), gross.alias("gross"), "l_tax", "l_extendedprice")
    return c.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("gross") - F.col("net") * (1 + F.col("l_tax"))) <= 0.0001).alias("tax_ok"), F.count_if(F.col("net") <= F.col("l_extendedprice")).alias("net_ok"))


# A table per customer: its orders by key, a subtotal after every fifth, a total at the end; some totals are wrong.
CELLS = """o AS (SELECT o_custkey AS t, o_orderkey, o_totalprice::DECIMAL(18,2) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS of FROM orders),
totals AS (SELECT t, n, 'SUBTOTAL' AS kind, (n + (n // 5))::INT AS row, sum(v) OVER (PARTITION BY t, (n - 1) // 5) AS computed FROM o QUALIFY n % 5 = 0 UNION ALL SELECT t, max(of), 'TOTAL', (max(of) + max(of) // 5 + 1)::INT, sum(v) FROM o GROUP BY t)"""


@R.add(f"""WITH {CELLS}, x AS (SELECT *, computed + CASE WHEN t % 7 = 0 AND kind = 'TOTAL' THEN 1 ELSE 0 END AS stated FROM totals) SELECT t AS o_custkey, row, kind, stated::DOUBLE AS stated, computed::DOUBLE AS computed, stated = computed AS ok FROM x""")
def table_totals(spark, d):
    w = W.partitionBy("t").orderBy("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("t"), "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("v")).withColumn("n", F.row_number().over(w))
    block = F.floor((F.col("n") - 1) / 5)
    details = o.select("t", (F.col("n") + block).cast("int").alias("row"), F.lit("order").alias("label"), F.col("v").cast("decimal(20,2)").alias("value"))
    subs = o.groupBy("t", block.alias("b")).agg(F.count("*").alias("c"), F.sum("v").alias("value")).filter("c = 5").select("t", ((F.col("b") + 1) * 6).cast("int").alias("row"), F.lit("Subtotal").alias("label"), F.col("value").cast("decimal(20,2)").alias("value"))
    end = o.groupBy("t").agg(F.max("n").alias("c"), F.sum("v").alias("value")).select("t", (F.col("c") + F.floor(F.col("c") / 5) + 1).cast("int").alias("row"), F.lit("Total").alias("label"), (F.col("value") + F.when(F.col("t") % 7 == 0, 1).otherwise(0)).cast("decimal(20,2)").alias("value"))
    got = ops.total_rows(details.unionByName(subs).unionByName(end), "t", "row", "label", "value")
    return got.select(F.col("t").alias("o_custkey"), "row", "kind", F.col("stated").cast("double").alias("stated"), F.col("computed").cast("double").alias("computed"), "ok")
