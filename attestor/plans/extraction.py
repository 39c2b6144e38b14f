"""Queries of extraction, parsing, set operations, and window-shaped operators that the other modules lack."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestor.functions import parse as P
from attestor.operators import joins, scoring, similarity, sinks, text as text_ops

from ._base import BLOCKS, EVENT_K, SENTENCES, Registry, table

R = Registry()


@R.add(f"""WITH {SENTENCES} SELECT doc_id, pos, CASE WHEN regexp_matches(lower(sentence), '\\b(if|would|might|may)\\b') THEN 'HYPOTHETICAL' WHEN regexp_matches(lower(sentence), '\\b(said|claims|alleged|according to)\\b') THEN 'REPORTED'
WHEN regexp_matches(lower(sentence), '\\b(not|no|never|none)\\b') THEN 'NEGATED' ELSE 'ASSERTED' END AS polarity, regexp_matches(sentence, '[0-9]') AS has_number FROM sentences WHERE regexp_matches(sentence, '([0-9]|\\bwas\\b|\\bare\\b)')""")
def claim_extraction(spark, d):
    from attestor.functions import text as T

    s = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s")).filter(F.col("s").rlike("[0-9]|" + T.whole("was|are")))
    return s.select("doc_id", "pos", P.polarity(F.col("s")).alias("polarity"), F.col("s").rlike("[0-9]").alias("has_number"))


LIC = r"(?:licensed under|licence:|License,) ([A-Za-z0-9 .-]{2,40})"


@R.add(f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:GNU [A-Za-z ]+License|CC BY[A-Z-]*|Apache License|MIT License)')) AS citation FROM documents)
SELECT citation, count(*) AS n, count(DISTINCT doc_id) AS n_docs, array_to_string(list_sort(list(DISTINCT doc_id))[1:5], ',') AS first_docs FROM c GROUP BY 1""")
def citation_extraction(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?:GNU [A-Za-z ]+License|CC BY[A-Z-]*|Apache License|MIT License)"), F.lit(0))).alias("citation"))
    # Five document ids per citation: ranks, not a list of all.
    ids = c.distinct().withColumn("r", F.row_number().over(W.partitionBy("citation").orderBy("doc_id"))).filter("r <= 5").groupBy("citation").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("first_docs"))
    return c.groupBy("citation").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).join(ids, "citation")


@R.add("SELECT o_orderkey, try_cast(replace(s, ',', '') AS DOUBLE) AS parsed FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE (o_orderkey // 1000) || ',' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') END AS s FROM orders)")
def number_parse(spark, d):
    k = F.col("o_orderkey")
    s = F.when(k % 10 == 0, "n/a").otherwise(F.concat(F.floor(k / 1000).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0")))
    return table(spark, d, "orders").select("o_orderkey", P.number(s).alias("parsed"))


@R.add("SELECT p_partkey, (p_partkey * 100000000 + p_size * 10000 + 7)::BIGINT AS won FROM part")
def korean_amount(spark, d):
    s = F.concat(F.col("p_partkey").cast("string"), F.lit("억 "), F.col("p_size").cast("string"), F.lit("만 7원"))
    return table(spark, d, "part").select("p_partkey", P.korean_amount(s).alias("won"))


@R.add("SELECT p_partkey, (p_size + p_partkey - 3)::BIGINT AS value FROM part")
def expression_eval(spark, d):
    s = F.concat(F.col("p_size").cast("string"), F.lit(" + "), F.col("p_partkey").cast("string"), F.lit(" - 3"))
    return table(spark, d, "part").select("p_partkey", P.expression(s).alias("value"))


@R.add("SELECT p_partkey, unnest(range(p_size, p_size + p_partkey % 4 + 1))::INT AS number FROM part")
def exhibit_ranges(spark, d):
    s = F.concat(F.lit("No. "), F.col("p_size").cast("string"), F.lit(" to "), (F.col("p_size") + F.col("p_partkey") % 4).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.explode(P.label_range(s)).alias("number"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate) || 'ab' || o_orderkey END AS number FROM orders")
def case_numbers(spark, d):
    s = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("no-"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit(" ab "), F.col("o_orderkey").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", P.case_number(s).alias("number"))


LUM = "(0.2126 * {0} + 0.7152 * {1} + 0.0722 * {2})"
CH = "CASE WHEN {0} / 255.0::DOUBLE <= 0.03928 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
A, B2 = LUM.format(CH.format("r"), CH.format("g"), CH.format("b")), LUM.format(CH.format("g"), CH.format("b"), CH.format("r"))


@R.add(f"WITH c AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_size * 5 % 256 AS g, p_partkey % 256 AS b FROM part) SELECT p_partkey, round((greatest({A}, {B2}) + 0.05) / (least({A}, {B2}) + 0.05), 4)::DOUBLE AS contrast FROM c")
def contrast_ratio(spark, d):
    c = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 256).alias("r"), (F.col("p_size") * 5 % 256).alias("g"), (F.col("p_partkey") % 256).alias("b"))
    return c.select("p_partkey", F.round(P.contrast(F.col("r"), F.col("g"), F.col("b"), F.col("g"), F.col("b"), F.col("r")), 4).alias("contrast"))


@R.add(f"""WITH {BLOCKS}, f AS (SELECT *, contains(text, ' | ') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - row_number() OVER (PARTITION BY doc_id, contains(text, ' | ') ORDER BY block_no) AS island FROM blocks)
SELECT doc_id, min(block_no) AS first_block, count(*) AS n_rows, sum(len(string_split(text, ' | ')))::BIGINT AS n_cells FROM f WHERE t GROUP BY doc_id, island HAVING count(*) >= 2""")
def table_continuation(spark, d):
    b = text_ops.blocks(table(spark, d, "documents")).withColumn("t", F.col("text").contains(" | "))
    island = F.row_number().over(W.partitionBy("doc_id").orderBy("block_no")) - F.row_number().over(W.partitionBy("doc_id", "t").orderBy("block_no"))
    b = b.withColumn("island", island).filter("t")
    return b.groupBy("doc_id", "island").agg(F.min("block_no").alias("first_block"), F.count("*").alias("n_rows"), F.sum(F.size(F.split("text", r" \| "))).alias("n_cells")).filter("n_rows >= 2").drop("island")


@R.add(f"""WITH {BLOCKS} SELECT text, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_a, sum(CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS n_b FROM blocks WHERE length(text) > 20 GROUP BY 1
HAVING sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) <> sum(CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END) AND count(*) > 1""")
def block_multiset_diff(spark, d):
    b = text_ops.blocks(table(spark, d, "documents")).filter(F.length("text") > 20)
    return similarity.multiset_diff(b.filter("doc_id % 2 = 0"), b.filter("doc_id % 2 = 1"), "text").filter("n_a + n_b > 1")


@R.add("""WITH g AS (SELECT doc_id FROM labels WHERE quality = 0), f AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'both' AS part, count(*) AS n FROM (FROM g INTERSECT FROM f) UNION ALL SELECT 'gold_only', count(*) FROM (FROM g EXCEPT FROM f) UNION ALL SELECT 'found_only', count(*) FROM (FROM f EXCEPT FROM g)""")
def label_sets(spark, d):
    g, f = (table(spark, d, "labels").filter(x).select("doc_id") for x in ("quality = 0", "toxic = 1"))
    n = lambda df, p: df.agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n")
    return n(g.intersect(f), "both").unionByName(n(g.subtract(f), "gold_only")).unionByName(n(f.subtract(g), "found_only"))


@R.add("""SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, round(value) ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def dedupe_first(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type", F.round("value").alias("v")).agg(F.min(F.struct("event_id", "value")).alias("m"))
    return e.select("m.event_id", "event_type", "m.value")


@R.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unreviewed(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@R.add("""WITH n AS (SELECT doc_id * 2 AS doc_id FROM documents) SELECT doc_id FROM n WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def insert_absent(spark, d):
    new = table(spark, d, "documents").select((F.col("doc_id") * 2).alias("doc_id"))
    return sinks.insert_absent(new, table(spark, d, "labels"), "doc_id")


@R.add("""SELECT user_id, count(*) AS n, '[' || string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', ',' ORDER BY event_id) || ']' AS body FROM events WHERE event_type <> 'click' GROUP BY 1""")
def custody_manifest(spark, d):
    return sinks.manifest(table(spark, d, "events").filter("event_type <> 'click'"), "user_id", "event_id", "event_type")


@R.add("""SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem""")
def nested_flatten(spark, d):
    l = table(spark, d, "lineitem")
    nested = l.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct("l_partkey", F.struct("l_suppkey", "l_quantity").alias("by"))).alias("lines"))).alias("payload"))
    back = nested.select("l_orderkey", F.from_json("payload", "struct<lines:array<struct<l_partkey:bigint,by:struct<l_suppkey:bigint,l_quantity:double>>>>").alias("p"))
    return back.select("l_orderkey", F.explode("p.lines").alias("x")).select("l_orderkey", "x.l_partkey", "x.by.l_suppkey", "x.by.l_quantity")


@R.add(f"SELECT event_type, {EVENT_K} % 3 = 0 AS extra, count(*) AS n FROM events GROUP BY 1, 2")
def closed_shape(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.when(k % 3 == 0, F.concat(F.lit('{"k":1,"x":2'), F.lit("}"))).otherwise(F.col("props"))
    keys = F.map_keys(F.from_json(body, "map<string,string>"))
    extra = F.size(F.array_except(keys, F.array(F.lit("k")))) > 0
    return table(spark, d, "events").select("event_type", extra.alias("extra")).groupBy("event_type", "extra").agg(F.count("*").alias("n"))


@R.add("""SELECT o_orderkey, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS early, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def declared_amendments(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    j = table(spark, d, "orders").select("o_orderkey", "o_orderdate").join(l, "o_orderkey", "left")
    return j.groupBy("o_orderkey").agg(F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("early"), F.count("l_shipdate").alias("n"))


@R.add("""WITH v AS (SELECT o_custkey, o_orderdate, o_orderpriority, lag(o_orderpriority) OVER w AS before, lead(o_orderpriority) OVER w AS after, o_orderkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, len(list_distinct([before, o_orderpriority, after])) > 1 AS differs FROM v""")
def version_outcomes(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    around = F.array(F.lag("o_orderpriority").over(w), F.col("o_orderpriority"), F.lead("o_orderpriority").over(w))
    return table(spark, d, "orders").select("o_orderkey", around.alias("a")).select("o_orderkey", (F.size(F.array_distinct(F.filter("a", lambda x: x.isNotNull()))) > 1).alias("differs"))


# Outliers from the usual size of a source (in steps of 256 characters) count only if they are few: a quarter, or two.
@R.add("""WITH k AS (SELECT source, length(text) // 256 AS size, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2),
m AS (SELECT source, arg_max(size, {'n': n, 'size': -size}) AS usual, sum(n) AS n, max(n) AS common FROM k GROUP BY 1)
SELECT source, n::BIGINT AS n, usual, (n - common)::BIGINT AS outliers, n >= 3 AND n > common AND n - common <= greatest(2, n // 4) AS suspicious FROM m""")
def forensic_outliers(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("source", F.floor(F.length("text") / 256).cast("long").alias("size"))
    return scoring.modal_outliers(docs, "source", "size")


@R.add(f"""WITH e AS (SELECT user_id, event_id, {EVENT_K} AS k FROM events), s AS (SELECT *, k = lag(k) OVER (PARTITION BY user_id ORDER BY event_id) + 1 AS cont FROM e) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE cont) AS continued FROM s GROUP BY 1""")
def serial_continuity(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").select("user_id", "event_id", k.alias("k")).withColumn("c", F.col("k") == F.lag("k").over(W.partitionBy("user_id").orderBy("event_id")) + 1)
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("c").alias("continued"))


@R.add("""WITH r AS (SELECT l_suppkey, l_partkey, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) SELECT l_partkey, min(r)::INT AS best FROM r GROUP BY 1 HAVING min(r) <= 24""")
def candidate_rank(spark, d):
    r = table(spark, d, "lineitem").withColumn("r", F.dense_rank().over(W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice")))).filter("r <= 24")
    return r.groupBy("l_partkey").agg(F.min("r").alias("best"))


@R.add("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), u AS (SELECT * FROM t WHERE r <= 3)
SELECT p_partkey, p_brand, r::INT AS r FROM u ORDER BY r, p_retailprice DESC, p_partkey LIMIT 12""")
def reserved_slots(spark, d):
    t = scoring.top_per_group(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3, "r")
    return t.orderBy("r", F.desc("p_retailprice"), "p_partkey").limit(12).select("p_partkey", "p_brand", "r")


@R.add("""SELECT p_partkey, (CASE WHEN p_partkey % 50 = 0 THEN 1000 ELSE 0 END + len(regexp_extract_all(p_name, '[aeiou]')))::BIGINT AS score FROM part ORDER BY score DESC, p_partkey LIMIT 20""")
def case_table_topk(spark, d):
    s = F.when(F.col("p_partkey") % 50 == 0, 1000).otherwise(0) + F.regexp_count("p_name", F.lit("[aeiou]"))
    return table(spark, d, "part").select("p_partkey", s.cast("long").alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)


@R.add("""SELECT c_mktsegment AS category, count(*) AS n, least(max(c_nationkey), 20)::INT AS capped FROM customer GROUP BY 1""")
def category_counts(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n"), F.least(F.max("c_nationkey"), F.lit(20)).alias("capped"))


@R.add("""SELECT c.c_custkey, n.n_name, count(DISTINCT o.o_orderkey) AS n_orders, arg_max(o.o_orderpriority, {'a': o.o_totalprice, 'b': o.o_orderkey}) AS top_priority, coalesce(max(o.o_totalprice), 0) AS top FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2""")
def review_items(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("top_priority"), F.max("o_totalprice").alias("top"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), "n_nationkey")
    return c.join(o, "c_custkey", "left").select("c_custkey", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "top_priority", F.coalesce("top", F.lit(0.0)).alias("top"))


@R.add("""SELECT l_partkey, list_sort(list(DISTINCT l_suppkey))[1] AS first_page, count(DISTINCT l_suppkey) AS n_pages, count(*) AS n FROM lineitem GROUP BY 1""")
def grouped_citations(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("first_page"), F.countDistinct("l_suppkey").alias("n_pages"), F.count("*").alias("n"))


@R.add(None)
def sequence_ratio(spark, d):
    b = table(spark, d, "benchmark").select("item_id", "text")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return pairs.select("item_id", F.round(similarity.ratio("text", "other"), 4).alias("ratio"), F.size(similarity.word_diff("text", "other")).alias("n_changes"))


@R.add(None)
def nfkc_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(similarity.nfkc("text").cast("binary")).alias("digest"))


@R.add("""WITH q AS (SELECT item_id, regexp_replace(text, '[ \\n]+', ' ', 'g') AS quote FROM benchmark), n AS (SELECT doc_id, regexp_replace(text, '[ \\n]+', ' ', 'g') AS t FROM documents)
SELECT item_id, count(*) FILTER (WHERE contains(t, quote)) AS exact, count(*) FILTER (WHERE NOT contains(t, quote) AND contains(t, substr(quote, 1, 60))) AS truncated FROM q, n GROUP BY 1""")
def quote_check(spark, d):
    squash = lambda c: F.regexp_replace(c, "[ \n]+", " ")
    q = table(spark, d, "benchmark").select("item_id", squash("text").alias("quote"))
    docs = table(spark, d, "documents").select("doc_id", squash("text").alias("text"))
    # Documents that hold the first 60 characters are found by their words; only those are read again.
    near = joins.contained(docs, q.select("item_id", F.substring("quote", 1, 60).alias("text")))
    found = near.join(q, "item_id").join(docs, "doc_id").groupBy("item_id").agg(F.count_if(F.col("text").contains(F.col("quote"))).alias("exact"), F.count("*").alias("all"))
    found = q.select("item_id").join(found, "item_id", "left")
    return found.select("item_id", F.coalesce("exact", F.lit(0)).alias("exact"), F.coalesce(F.col("all") - F.col("exact"), F.lit(0)).alias("truncated"))
