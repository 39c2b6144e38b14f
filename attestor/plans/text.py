"""Queries over documents and pages: blocks, statistics, scans, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import sinks, text as ops

from ._base import BLOCKS, SENTENCES, TOKENS, Registry, table

R = Registry()


@R.add(f"WITH {BLOCKS} SELECT doc_id, block_no, length(text) AS n_chars FROM blocks WHERE trim(text) <> ''")
def blocks_explode(spark, d):
    return ops.blocks(table(spark, d, "documents")).filter(F.trim("text") != "").select("doc_id", "block_no", F.length("text").cast("long").alias("n_chars"))


LAYERS = f"""{BLOCKS}, heads AS (SELECT text FROM blocks WHERE block_no = 0 GROUP BY text HAVING count(DISTINCT doc_id) > 1),
layers AS (SELECT doc_id, block_no, b.text, CASE WHEN contains(b.text, '%%%') THEN 'hidden_text' WHEN contains(b.text, '|') THEN 'ocr_layer' ELSE 'visible_text' END AS source_layer,
  CASE WHEN h.text IS NOT NULL THEN 'running_head' ELSE 'paragraph' END AS block_type FROM blocks b LEFT JOIN heads h ON b.block_no = 0 AND b.text = h.text)"""


@R.add(f"WITH {LAYERS} SELECT source_layer, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM layers WHERE trim(text) <> '' AND source_layer IN ('visible_text','ocr_layer') AND block_type <> 'running_head' GROUP BY 1")
def body_blocks(spark, d):
    b = ops.body_blocks(ops.layer_blocks(table(spark, d, "documents")))
    return b.groupBy("source_layer").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@R.add(f"WITH {LAYERS} SELECT doc_id, source_layer, block_type, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM layers WHERE source_layer = 'hidden_text' OR block_type = 'running_head' GROUP BY ALL")
def block_viewer(spark, d):
    b = ops.layer_blocks(table(spark, d, "documents")).filter((F.col("source_layer") == "hidden_text") | (F.col("block_type") == "running_head"))
    return b.groupBy("doc_id", "source_layer", "block_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@R.add(f"""WITH {BLOCKS}, last AS (SELECT doc_id, max(block_no) AS last FROM blocks GROUP BY 1)
SELECT trim(lower(regexp_replace(text, '[0-9]+', '#', 'g'))) AS signature, count(DISTINCT doc_id) AS n_docs FROM blocks JOIN last USING (doc_id)
WHERE (block_no < 1 OR block_no > last - 1) AND trim(text) <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2""")
def running_heads(spark, d):
    return ops.running_heads(ops.blocks(table(spark, d, "documents")))


@R.add(f"WITH {TOKENS} SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, substr(token, 1, 80) AS token FROM tokens) GROUP BY 1")
def token_counts(spark, d):
    return ops.token_counts(table(spark, d, "documents"))


@R.add(f"WITH {TOKENS} SELECT substr(t, i, 2) AS pair, count(*) AS n FROM (SELECT substr(token, 1, 80) AS t, unnest(range(1, length(substr(token, 1, 80)))) AS i FROM tokens) GROUP BY 1")
def token_bigrams(spark, d):
    return ops.pair_counts(table(spark, d, "documents"))


@R.add(f"WITH {SENTENCES} SELECT doc_id, count(*) AS n, max(length(sentence))::BIGINT AS longest, sum(length(sentence))::BIGINT AS n_chars FROM sentences GROUP BY 1")
def sentence_stats(spark, d):
    return ops.sentence_lengths(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("len").cast("long").alias("longest"), F.sum("len").alias("n_chars"))


@R.add(f"""WITH {SENTENCES}, s AS (SELECT doc_id, count(*) AS n_sentences, stddev_pop(length(sentence)) / avg(length(sentence)) AS cv FROM sentences GROUP BY 1 HAVING count(*) >= 5),
t AS (SELECT doc_id, len(list_distinct(x)) / len(x) AS ttr FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') AS x FROM documents))
SELECT doc_id, n_sentences, round(cv, 4) AS cv, round(ttr, 4) AS ttr FROM s JOIN t USING (doc_id)""")
def stylometry(spark, d):
    return ops.stylometry(table(spark, d, "documents"))


@R.add(f"""WITH {SENTENCES}, s AS (SELECT doc_id, pos, length(sentence) AS len, count(*) OVER (PARTITION BY doc_id) AS n FROM sentences),
g AS (SELECT doc_id, n, avg(CASE WHEN pos < n // 2 THEN len END) AS a, avg(CASE WHEN pos >= n // 2 THEN len END) AS b FROM s WHERE n >= 10 GROUP BY 1, 2)
SELECT doc_id, n, round(a, 4) AS first_mean, round(b, 4) AS second_mean, abs(a - b) / greatest(a, b) > 0.6 AS shifted FROM g""")
def style_shift(spark, d):
    return ops.style_shift(table(spark, d, "documents"))


@R.add(r"""SELECT doc_id, len(regexp_extract_all(text, '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{AD}\x{E0000}-\x{E007F}]')) AS n_invisible,
len(regexp_extract_all(text, '[A-Za-z][\x{400}-\x{4FF}]|[\x{400}-\x{4FF}][A-Za-z]')) AS n_mixed, len(regexp_extract_all(text, '[^\x00-\x7F]')) AS n_not_ascii,
len(regexp_extract_all(text, '\b[A-Za-z]( [A-Za-z]){3,}\b')) AS n_spaced FROM documents""")
def unicode_scan(spark, d):
    return ops.unicode_scan(table(spark, d, "documents"))


@R.add(r"""WITH k(kind, p) AS (VALUES ('hex', '\b[0-9a-f]{24,}\b'), ('base64', '\b[A-Za-z0-9+/]{40,}={0,2}'), ('url', '(?:%[0-9A-Fa-f]{2}){2,}'), ('entity', '&#?[a-z0-9]{2,8};')),
f AS (SELECT doc_id, 'hex' AS kind, unnest(regexp_extract_all(text, '\b[0-9a-f]{24,}\b')) AS token FROM documents
UNION ALL SELECT doc_id, 'base64', unnest(regexp_extract_all(text, '\b[A-Za-z0-9+/]{40,}={0,2}')) FROM documents
UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(text, '(?:%[0-9A-Fa-f]{2}){2,}')) FROM documents
UNION ALL SELECT doc_id, 'entity', unnest(regexp_extract_all(text, '&#?[a-z0-9]{2,8};')) FROM documents) SELECT * FROM f""")
def encoding_scan(spark, d):
    return ops.encoding_scan(table(spark, d, "documents"))


@R.add(f"""WITH {BLOCKS}, b AS (SELECT doc_id, count(*) AS n_blocks, sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS l, sum(length(regexp_replace(text, '[ \\t\\r\\n]', '', 'g'))) AS s FROM blocks WHERE trim(text) <> '' GROUP BY 1)
SELECT doc_id, n_blocks, round(l / s, 4) AS letter_ratio, l / s >= 0.5 AS ok FROM b""")
def ocr_quality(spark, d):
    return ops.ocr_quality(ops.blocks(table(spark, d, "documents")).filter(F.trim("text") != ""))


HTML = r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
'(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(br|/p|/div|/h[1-6]|/li|/tr)[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')) AS text FROM pages"""


@R.add(f"SELECT page_id, length(text) AS n_chars, md5(text) AS digest FROM ({HTML})")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text")).select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@R.add(f"""WITH a AS (SELECT page_id, c, count(*) AS n FROM (SELECT page_id, unnest(string_split(lower(text), '')) AS c FROM ({HTML})) WHERE c NOT IN ('', ' ', chr(10)) GROUP BY 1, 2),
b AS (SELECT page_id, c, count(*) AS m FROM (SELECT page_id, unnest(string_split(lower(html), '')) AS c FROM pages) WHERE c NOT IN ('', ' ', chr(10)) GROUP BY 1, 2),
g AS (SELECT page_id, sum(least(coalesce(n, 0), coalesce(m, 0))) / sum(greatest(coalesce(n, 0), coalesce(m, 0))) AS o FROM a FULL JOIN b USING (page_id, c) GROUP BY 1)
SELECT page_id, round(o, 4) AS overlap, o < 0.6 AS disagree FROM g""")
def layer_overlap(spark, d):
    p = table(spark, d, "pages")
    return ops.layer_overlap(p.select("page_id", T.html_to_text(F.col("html")).alias("text")), p.select("page_id", F.col("html").alias("text")), "page_id")


@R.add("""SELECT doc_id, i AS chunk_no, i * 1040 AS start, md5(substr(text, i * 1040 + 1, 1200)) AS digest FROM (
SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 160) / 1040))::INT))::INT AS i FROM documents WHERE text <> '')""")
def fixed_chunks(spark, d):
    return ops.chunks(table(spark, d, "documents")).select("doc_id", "chunk_no", "start", F.md5(F.col("text").cast("binary")).alias("digest"))


@R.add(f"""WITH {BLOCKS}, f AS (SELECT *, CASE WHEN lag(regexp_matches(trim(text), '[.!?]$')) OVER w IS NOT FALSE THEN 1 ELSE 0 END AS new FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY block_no) AS paragraph FROM f)
SELECT doc_id, paragraph::BIGINT AS paragraph, min(block_no) AS first_block, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars FROM g GROUP BY 1, 2""")
def paragraph_islands(spark, d):
    return ops.paragraphs(ops.blocks(table(spark, d, "documents")))


@R.add(f"""WITH {BLOCKS}, e AS (SELECT doc_id, block_no, text, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS e FROM blocks)
SELECT doc_id, block_no, (e - length(text))::BIGINT AS start, e::BIGINT AS stop FROM e""")
def reading_offsets(spark, d):
    return ops.reading_text(ops.blocks(table(spark, d, "documents")))


@R.add(f"WITH {BLOCKS} SELECT doc_id, count(*) AS n_left FROM blocks WHERE NOT (contains(text, '%%%') OR contains(text, '!!') OR contains(text, '***')) GROUP BY 1")
def strip_injections(spark, d):
    flagged = spark.createDataFrame([("%%%",), ("!!",), ("***",)], "observed string")
    return ops.strip_observed(ops.blocks(table(spark, d, "documents")), flagged).groupBy("doc_id").agg(F.count("*").alias("n_left"))


@R.add(r"SELECT doc_id, md5(lower(trim(regexp_replace(translate(regexp_replace(text, '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{AD}]', '', 'g'), 'АВЕКМНОРСТУХаеорсух“”‘’·', 'ABEKMHOPCTYXaeopcyx""''.'), '[ \t\n\r]+', ' ', 'g')))) AS digest FROM documents")
def match_normalisation(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.match_form(F.col("text")).cast("binary")).alias("digest"))


@R.add("SELECT CASE WHEN regexp_matches(text, '^[=+@-]') THEN '''' || text ELSE text END AS cell, count(*) AS n FROM (SELECT trim(unnest(string_split(text, ' '))) AS text FROM documents) WHERE text <> '' AND regexp_matches(text, '^[=+@0-9-]') GROUP BY 1")
def csv_safe_cells(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("text")).select(F.trim("text").alias("text")).filter(F.col("text").rlike("^[=+@0-9-]"))
    return w.groupBy(T.csv_safe(F.col("text")).alias("cell")).agg(F.count("*").alias("n"))


@R.add("""SELECT sha256(text) AS ref, count(*) AS n_uses, min(doc_id) AS first_doc, max(length(text))::BIGINT AS n_chars, ((count(*) - 1) * max(length(text)))::BIGINT AS saved FROM documents WHERE length(text) >= 200 GROUP BY 1""")
def content_pool(spark, d):
    return sinks.content_pool(table(spark, d, "documents"), least=200)


@R.add("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS snapshot FROM orders""")
def frozen_snapshot(spark, d):
    return sinks.snapshot(table(spark, d, "orders"), "o_orderkey", ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"])


@R.add("""SELECT event_id, '$.k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, '$.type', event_type FROM events""")
def json_leaves(spark, d):
    e = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("type"))).alias("j"))
    return sinks.leaves(e, "event_id", "j")
