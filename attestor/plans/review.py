"""Queries of reviews: components, health, item scores, claim order, windows of a query, unions, units, leaves, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestor.functions import text as T
from attestor.operators import retrieval, review as ops, rules, text as text_ops

from ._base import BLOCKS, EVENT_K, SENTENCES, TOKENS, Registry, table
from .rules import FOUND_SQL, PII_SQL

R = Registry()

# Four steps per line of an order, their states read off its columns.
STEPS = """parts AS (SELECT l_orderkey, l_linenumber, 'existence' AS step, CASE l_returnflag WHEN 'A' THEN 'NOT_FOUND' WHEN 'R' THEN 'CONFIRMED' ELSE 'CONFIRMED' END AS status FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'article', CASE WHEN l_linestatus = 'O' THEN 'NOT_APPLICABLE' WHEN l_quantity > 40 THEN 'INVALID_FORMAT' ELSE 'CONFIRMED' END FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'content', CASE WHEN l_discount > 0.08 THEN 'MISMATCH' WHEN l_tax > 0.04 THEN 'UNVERIFIED' ELSE 'CONFIRMED' END FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'temporal', CASE WHEN l_quantity < 10 THEN 'REVIEW_NEEDED' ELSE 'CONFIRMED' END FROM lineitem)"""


@R.add(f"""WITH {STEPS}, e AS (SELECT l_orderkey, l_linenumber, bool_or(step = 'existence' AND status = 'CONFIRMED') AND bool_or(step = 'article' AND status IN ('CONFIRMED', 'NOT_APPLICABLE')) AS known, bool_or(step = 'temporal' AND status <> 'CONFIRMED') AS pending,
bool_or(step = 'content' AND status = 'CONFIRMED') AS content, bool_or(status = 'INVALID_FORMAT') AS i, bool_or(status = 'NOT_FOUND') AS m, bool_or(status = 'MISMATCH') AS x FROM parts GROUP BY 1, 2)
SELECT l_orderkey, count(*) AS entries, count(*) FILTER (WHERE known) AS identity_confirmed, count(*) FILTER (WHERE known AND content AND NOT x) AS content_confirmed, count(*) FILTER (WHERE known AND pending) AS temporal_pending,
count(*) FILTER (WHERE i) AS invalid_format, count(*) FILTER (WHERE m AND NOT i) AS not_found, count(*) FILTER (WHERE x AND NOT m AND NOT i) AS mismatch, count(*) FILTER (WHERE NOT known AND NOT x AND NOT m AND NOT i) AS unverified FROM e GROUP BY 1""")
def component_summary(spark, d):
    step = lambda name, status: F.struct(F.lit(name).alias("step"), status.alias("status"))
    steps = F.array(
        step("existence", F.when(F.col("l_returnflag") == "A", "NOT_FOUND").otherwise("CONFIRMED")),
        step("article", F.when(F.col("l_linestatus") == "O", "NOT_APPLICABLE").when(F.col("l_quantity") > 40, "INVALID_FORMAT").otherwise("CONFIRMED")),
        step("content", F.when(F.col("l_discount") > 0.08, "MISMATCH").when(F.col("l_tax") > 0.04, "UNVERIFIED").otherwise("CONFIRMED")),
        step("temporal", F.when(F.col("l_quantity") < 10, "REVIEW_NEEDED").otherwise("CONFIRMED")),
    )
    return ops.component_summary(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.inline(steps)), "l_orderkey", "l_linenumber")


@R.add(f"""WITH c AS (SELECT user_id, ([200, 200, 200, 404, 429, 500])[{EVENT_K} % 6 + 1] AS status, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, sum(n)::BIGINT AS calls, sum(CASE WHEN status <> 200 THEN n ELSE 0 END)::BIGINT AS errors, sum(CASE WHEN status = 429 THEN n ELSE 0 END)::BIGINT AS throttled, string_agg(status || '=' || n, ',' ORDER BY status) AS states FROM c GROUP BY 1""")
def source_health(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.element_at(F.array(*(F.lit(s) for s in (200, 200, 200, 404, 429, 500))), k % 6 + 1)
    return ops.source_health(table(spark, d, "events").select("user_id", status.alias("status")), "user_id", "status")


@R.add("""WITH i AS (SELECT l_orderkey, l_linenumber AS item, bool_or(l_returnflag = 'R') AS trap, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2),
f AS (SELECT l_orderkey, l_linenumber AS item FROM lineitem WHERE l_linenumber % 2 = 1 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 UNION ALL SELECT l_orderkey, NULL FROM lineitem WHERE l_discount > 0.08),
h AS (SELECT l_orderkey, item, count(*) AS hits FROM f WHERE item IS NOT NULL GROUP BY 1, 2), l AS (SELECT l_orderkey, count(*) AS lost FROM f WHERE item IS NULL GROUP BY 1),
g AS (SELECT l_orderkey, coalesce(sum(weight) FILTER (WHERE NOT trap AND hits > 0), 0) AS got, coalesce(sum(weight) FILTER (WHERE NOT trap), 0) AS al, coalesce(sum(hits) FILTER (WHERE NOT trap), 0) AS tp, coalesce(sum(hits) FILTER (WHERE trap), 0) AS traps,
coalesce(sum(hits - 1) FILTER (WHERE NOT trap AND hits > 1), 0) AS dup FROM i LEFT JOIN h USING (l_orderkey, item) GROUP BY 1)
SELECT l_orderkey, round(got / nullif(al, 0), 4) AS recall, round(tp / nullif(tp + traps + coalesce(lost, 0), 0), 4) AS precision, tp::BIGINT AS tp, (traps + coalesce(lost, 0))::BIGINT AS fp, traps::BIGINT AS traps, dup::BIGINT AS duplicates FROM g LEFT JOIN l USING (l_orderkey)""")
def item_scores(spark, d):
    l = table(spark, d, "lineitem")
    items = l.groupBy("l_orderkey", F.col("l_linenumber").alias("item")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("trap"), F.sum("l_quantity").alias("weight"))
    named = F.filter(F.array(F.when(F.col("l_linenumber") % 2 == 1, F.struct(F.col("l_linenumber").alias("item"))), F.when(F.col("l_quantity") > 30, F.struct(F.col("l_linenumber").alias("item"))), F.when(F.col("l_discount") > 0.08, F.struct(F.lit(None).cast(items.schema["item"].dataType).alias("item")))), lambda x: x.isNotNull())
    return ops.item_scores(items, l.select("l_orderkey", F.inline(named)), "l_orderkey")


@R.add(f"""WITH {SENTENCES}, c AS (SELECT doc_id, pos, regexp_matches(sentence, 'License|licensed') AS cited, CASE WHEN regexp_matches(sentence, '\\b(must|shall)\\b') THEN 'LEGAL_RULE' WHEN regexp_matches(sentence, '\\b(was|were|is|are)\\b') THEN 'FACT' ELSE 'OPINION' END AS kind, regexp_matches(sentence, '[0-9]') AS valued, sentence FROM sentences)
SELECT doc_id, pos, CASE WHEN cited THEN 1 WHEN kind = 'LEGAL_RULE' OR valued THEN 2 WHEN length(regexp_replace(sentence, '\\s', '', 'g')) < 15 THEN 5 WHEN kind = 'FACT' THEN 3 ELSE 4 END::INT AS tier,
row_number() OVER (PARTITION BY doc_id ORDER BY tier, pos)::INT AS place FROM c""")
def claim_order(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    kind = F.when(F.col("s").rlike(r"\b(must|shall)\b"), "LEGAL_RULE").when(F.col("s").rlike(r"\b(was|were|is|are)\b"), "FACT").otherwise("OPINION")
    s = s.select("doc_id", "pos", ops.claim_tier(F.col("s").rlike("License|licensed"), kind, F.col("s").rlike("[0-9]"), F.col("s")).alias("tier"))
    return s.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("tier", "pos")))


@R.add("""WITH w AS (SELECT w, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower(text), '[가-힣]{3,}|[a-z]{3,}')) AS w FROM benchmark) GROUP BY 1 ORDER BY c DESC, w LIMIT 80), n AS (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS name FROM documents)
SELECT doc_id, round(sum((1 + ln(c)) * length(w)), 3) AS score, count(*)::INT AS n_matched FROM n, w WHERE contains(name, w) GROUP BY 1""")
def metadata_priority(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[가-힣]{3,}|[a-z]{3,}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    top = [(r["w"], r["c"]) for r in words.orderBy(F.desc("c"), "w").limit(80).collect()]
    names = table(spark, d, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("name"))
    return ops.name_scores(names, "doc_id", "name", top)


OUTPUTS = f"""{FOUND_SQL}, p AS ({PII_SQL}), o AS (SELECT 'rules' AS engine, 0 AS o, doc_id, rule_id AS rule, sum(hits)::BIGINT AS value FROM f GROUP BY doc_id, rule_id
UNION ALL SELECT 'personal', 1, doc_id, CASE kind WHEN 'email' THEN 'address' ELSE kind END, count(*) FROM p GROUP BY ALL)"""


def outputs(spark, d):
    docs = table(spark, d, "documents")
    found = rules.rule_findings(text_ops.blocks(docs), "doc_id", "block_no").groupBy("doc_id", F.col("rule_id").alias("rule")).agg(F.sum("hits").alias("value"))
    n = F.array(*(F.struct(F.lit("address" if k == "email" else k).alias("rule"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))).cast("long").alias("value")) for k, p in rules.PII.items()))
    return ops.union_outputs({"rules": found, "personal": docs.select("doc_id", F.inline(n)).filter("value > 0")}, "doc_id")


@R.add(OUTPUTS + " SELECT engine, doc_id, rule, value FROM o")
def engine_union(spark, d):
    return outputs(spark, d)[0]


@R.add(OUTPUTS + " SELECT doc_id, rule, arg_min(engine, o) AS engine, arg_min(value, o) AS value FROM o GROUP BY ALL")
def engine_first_wins(spark, d):
    return outputs(spark, d)[1]


@R.add(rf"""WITH RECURSIVE {BLOCKS}, n AS (SELECT doc_id, block_no, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS i, len([x FOR x IN string_split(regexp_replace(text, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1)) IF trim(x) <> '']) AS s FROM blocks WHERE trim(text) <> ''),
u AS (SELECT doc_id, block_no, i, s, 0 AS unit, s AS held FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.block_no, n.i, n.s, CASE WHEN u.held >= 3 THEN u.unit + 1 ELSE u.unit END, CASE WHEN u.held >= 3 THEN n.s ELSE u.held + n.s END FROM u JOIN n ON n.doc_id = u.doc_id AND n.i = u.i + 1)
SELECT doc_id, unit, min(block_no) AS first_block, count(*)::INT AS n_blocks, sum(s)::INT AS n_sentences FROM u GROUP BY 1, 2""")
def greedy_units(spark, d):
    return ops.greedy_units(table(spark, d, "documents"))


# Documents whose id is divisible by 50 are the queries: whole, and by windows of 800 characters every 600.
WINDOWS = f"""{TOKENS}, idx AS (SELECT doc_id, token AS term, count(*) AS tf FROM (SELECT doc_id, substr(token, 1, 80) AS token FROM tokens) GROUP BY 1, 2),
nn AS (SELECT count(*) AS n FROM documents), idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM nn) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM idx GROUP BY 1),
win AS (SELECT doc_id, 0 AS w, text FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT doc_id, i + 1, substr(text, i * 600 + 1, 800) FROM (SELECT doc_id, text, unnest(range((length(text) + 599) // 600)) AS i FROM documents WHERE doc_id % 50 = 0 AND length(text) > 1200) WHERE length(text) - i * 600 >= 160),
wt AS (SELECT doc_id, w, term, count(*) AS tf FROM (SELECT doc_id, w, substr(unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')), 1, 80) AS term FROM win) GROUP BY 1, 2, 3),
pr AS (SELECT doc_id, w, term, idf, row_number() OVER (PARTITION BY doc_id, w ORDER BY round((1 + ln(tf)) * idf, 6) DESC, term) AS rank FROM wt JOIN idf USING (term), nn WHERE df <= 0.5 * n OR n < 20),
al AS (SELECT doc_id, w, sum(idf) AS a FROM pr WHERE rank <= 40 GROUP BY 1, 2), bt AS (SELECT DISTINCT item_id, substr(unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')), 1, 80) AS term FROM benchmark),
g AS (SELECT doc_id, w, item_id, count(*) AS matches, sum(idf) AS got FROM pr JOIN bt USING (term) WHERE rank <= 40 GROUP BY 1, 2, 3), c AS (SELECT doc_id, w, item_id, matches, round(got / a, 4) AS coverage, got / a >= 0.1 AND matches >= 4 AS qualified FROM g JOIN al USING (doc_id, w))"""


@R.add(f"WITH {WINDOWS} SELECT doc_id, item_id, w::INT AS w, matches, coverage, qualified FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY qualified DESC, coverage DESC, matches DESC, w) = 1")
def best_window(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    q = docs.filter("doc_id % 50 = 0 and text is not null")
    starts = F.when(F.length("text") > 1200, F.filter(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 600).cast("int")), lambda i: F.length("text") - i * 600 >= 160)).otherwise(F.array().cast("array<int>"))
    parts = F.concat(F.array(F.struct(F.lit(0).alias("w"), F.col("text").alias("part"))), F.transform(starts, lambda i: F.struct((i + 1).alias("w"), F.substring("text", i * 600 + 1, F.lit(800)).alias("part"))))
    win = q.select("doc_id", F.inline(parts)).select(F.struct("doc_id", "w").alias("key"), F.col("part").alias("text"))
    own = retrieval.postings(win, "key")
    n = docs.count()
    idfs = retrieval.idf(retrieval.postings(docs, "doc_id", own), "doc_id", n)
    profile = retrieval.profile(own, idfs, "key", n).join(idfs.select("term", "idf"), "term")
    total = profile.groupBy("key").agg(F.sum("idf").alias("all"))
    items = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    g = profile.join(items, "term").groupBy("key", "item_id").agg(F.count("*").alias("matches"), F.sum("idf").alias("got")).join(total, "key").withColumn("share", F.col("got") / F.col("all"))
    best = F.max(F.struct(((F.col("share") >= 0.1) & (F.col("matches") >= 4)).alias("qualified"), F.round("share", 4).alias("coverage"), "matches", (-F.col("key.w")).alias("back")))
    g = g.groupBy(F.col("key.doc_id").alias("doc_id"), "item_id").agg(best.alias("b"))
    return g.select("doc_id", "item_id", (-F.col("b.back")).alias("w"), "b.matches", "b.coverage", "b.qualified")


@R.add("""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)
SELECT l_orderkey, 'order.key' AS path, l_orderkey::VARCHAR AS value FROM l GROUP BY 1 UNION ALL SELECT DISTINCT l_orderkey, 'notes', '[]' FROM l UNION ALL SELECT l_orderkey, 'order.lines[' || i || '].part', l_partkey::VARCHAR FROM l UNION ALL SELECT l_orderkey, 'order.lines[' || i || '].by', 's' || l_suppkey FROM l""")
def nested_leaves(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    lines = F.transform("l", lambda x: F.struct(x["l_partkey"].alias("part"), F.concat(F.lit("s"), x["l_suppkey"].cast("string")).alias("by")))
    j = l.select("l_orderkey", F.to_json(F.struct(F.struct(F.col("l_orderkey").alias("key"), lines.alias("lines")).alias("order"), F.array().cast("array<string>").alias("notes"))).alias("j"))
    return j.select("l_orderkey", F.inline(ops.json_leaves("j")))


@R.add("""SELECT c_custkey, '{"party":"[name]","notes":["call [phone], [name]",' || c_custkey || '],"sub":{"mail":"[email]"}}' AS body FROM customer""")
def shareable_snapshot(spark, d):
    body = F.concat(F.lit('{"party":"'), "c_name", F.lit('","notes":["call 010-1234-5678, '), "c_name", F.lit('",'), F.col("c_custkey").cast("string"), F.lit('],"sub":{"mail":"a.b@example.com","memo":"secret"}}'))
    j = table(spark, d, "customer").select("c_custkey", body.alias("j"), F.array("c_name", F.lit("Customer")).alias("names"))
    return j.select("c_custkey", ops.shareable("j", "names", rules.PII, drop=("memo",)).alias("body"))


@R.add("SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def numbering_duplicates(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).filter("n > 1")


@R.add(f"""WITH {BLOCKS}, f AS (SELECT count(*) AS n FROM blocks WHERE trim(text) <> ''), e AS (SELECT count(*) AS n FROM blocks WHERE contains(text, ' | ')), d AS (SELECT count(*) AS n FROM documents)
SELECT 0::INT AS position, 'blocks' AS stage, d.n AS inputs, f.n AS outputs, NULL AS skipped FROM d, f UNION ALL SELECT 1, 'ocr', NULL, NULL, 'NO_SCANS' UNION ALL SELECT 2, 'tables', f.n, e.n, NULL FROM f, e""")
def run_manifest(spark, d):
    from attestor.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    m = ops.RunManifest(spark)
    keep = lambda df: df.checkpoint()
    b = m.stage("blocks", lambda x: text_ops.blocks(x).filter(F.trim("text") != ""), table(spark, d, "documents"), keep)
    b = m.stage("ocr", lambda x: x, b, keep, skip="NO_SCANS")
    m.stage("tables", lambda x: x.filter(F.col("text").contains(" | ")), b, keep)
    return m.table().select("position", "stage", "inputs", "outputs", "skipped")
