"""Queries of the rule engine and of personal-data detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import rules as ops, text as text_ops

from ._base import BLOCKS, SENTENCES, Registry, table

R = Registry()


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


# Patterns must be constants for the oracle's regular expressions.
HITS_SQL = " UNION ALL ".join(f"SELECT doc_id, block_no, {_q(r)} AS rule_id, {_q(c)} AS category, {w}::DOUBLE AS weight, len(regexp_extract_all(text, {_q(p)})) AS hits FROM blocks WHERE regexp_matches(text, {_q(p)})" for r, p, w, c in ops.RULES)
FOUND_SQL = f"WITH {BLOCKS}, f AS ({HITS_SQL})"


def findings(spark, d):
    return ops.rule_findings(text_ops.blocks(table(spark, d, "documents")), "doc_id", "block_no")


@R.add(FOUND_SQL + " SELECT doc_id, block_no, rule_id, category, weight, hits FROM f")
def rule_findings(spark, d):
    return findings(spark, d)


@R.add(FOUND_SQL + """, g AS (SELECT doc_id, sum(weight) AS s, count(DISTINCT rule_id) AS n_rules FROM f GROUP BY 1)
SELECT doc_id, round(s, 4) AS score, n_rules, CASE WHEN s >= 3.0 AND n_rules >= 2 THEN 'CONFIRMED' WHEN s >= 2.0 AND n_rules >= 1 THEN 'LIKELY' WHEN s >= 0.8 THEN 'SUSPECT' ELSE 'NONE' END AS verdict FROM g""")
def injection_score(spark, d):
    return ops.injection_class(findings(spark, d), "doc_id")


@R.add(FOUND_SQL + " SELECT doc_id, count(DISTINCT category) AS n_categories FROM f GROUP BY 1 HAVING count(DISTINCT category) >= 2")
def residue_categories(spark, d):
    return ops.residue(findings(spark, d))


PII_SQL = " UNION ALL ".join(f"SELECT doc_id, text, '{k}' AS kind, unnest(list_distinct(regexp_extract_all(text, {_q(p)}))) AS value FROM documents" for k, p in ops.PII.items())
# The place of the i-th match: all pieces up to it and all matches before it.
PLACE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(text, {_q(p)}) AS m, string_split_regex(text, {_q(p)}) AS g FROM documents WHERE regexp_matches(text, {_q(p)})" for k, p in ops.PII.items()
)
SPAN_SQL = f"""WITH m AS ({PLACE_SQL}), i AS (SELECT doc_id, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM m),
s AS (SELECT doc_id, kind, m[i] AS value, (1 + list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0))::INT AS start,
(1 + list_sum([length(x) FOR x IN g[1:i]]) + list_sum([length(x) FOR x IN m[1:i]]))::INT AS stop FROM i),
r AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
spans AS (SELECT doc_id, kind, value, start, stop FROM r WHERE reach IS NULL OR stop > reach)"""


@R.add(f"WITH p AS ({PII_SQL}) SELECT doc_id, kind, count(*) AS n FROM p GROUP BY 1, 2")
def pii_counts(spark, d):
    docs = table(spark, d, "documents")
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))).cast("long").alias("n")) for k, p in ops.PII.items()))
    return docs.select("doc_id", F.inline(found)).filter("n > 0")


@R.add(SPAN_SQL + " SELECT * FROM spans")
def pii_spans(spark, d):
    return ops.pii_spans(table(spark, d, "documents"))


@R.add(SPAN_SQL + """, f AS (SELECT kind, value, min({'doc_id': doc_id, 'start': start}) AS spot FROM spans GROUP BY 1, 2)
SELECT kind, value, upper(kind) || '_' || lpad((row_number() OVER (PARTITION BY kind ORDER BY spot, value))::VARCHAR, 4, '0') AS pseudonym FROM f""")
def stable_pseudonyms(spark, d):
    return ops.pseudonyms(ops.pii_spans(table(spark, d, "documents")))


_MASK = "text"
for _k, _p in ops.PII.items():
    _MASK = f"regexp_replace({_MASK}, {_q(_p)}, '[{_k}]', 'g')"


@R.add(f"SELECT doc_id, md5({_MASK}) AS digest, {_MASK} <> text AS changed FROM documents")
def pii_mask(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", ops.mask_pii(F.col("text")).alias("m"))
    return docs.select("doc_id", F.md5(F.col("m").cast("binary")).alias("digest"), (F.col("m") != F.col("text")).alias("changed"))


CARDS = "cards AS (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all(text, '[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}')), '[^0-9]', '', 'g') AS digits FROM documents)"


@R.add(f"""WITH {CARDS}, x AS (SELECT digits, [substr(digits, i, 1)::INT FOR i IN range(1, 17)] AS v FROM cards)
SELECT digits, list_sum([CASE WHEN i % 2 = 0 THEN v[i] ELSE (v[i] * 2) % 10 + (v[i] * 2) // 10 END FOR i IN range(1, 17)]) % 10 = 0 AS luhn,
(list_sum([v[i] * ([2,3,4,5,6,7,8,9,2,3,4,5])[i] FOR i IN range(1, 13)]) % 11)::INT AS weighted, len(list_distinct(v)) = 1 OR contains('0123456789012345678', digits) AS placeholder FROM x""")
def check_digits(spark, d):
    c = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"), F.lit(0))).alias("c")).select(T.digits_only(F.col("c")).alias("digits")).distinct()
    same = F.size(F.array_distinct(F.filter(F.split("digits", ""), lambda x: x != ""))) == 1
    return c.select("digits", T.luhn_ok(F.col("digits")).alias("luhn"), T.weighted_check(F.col("digits"), [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5], 11).alias("weighted"), (same | F.lit("0123456789012345678").contains(F.col("digits"))).alias("placeholder"))


@R.add("""WITH items(item, trig, mention) AS (VALUES ('licence_name', '[Ll]icen[sc]e', '(MIT|Apache|GNU|CC|BSD)'), ('token_value', 'token', '[0-9a-f]{24,}'), ('line_break', 'the', chr(10)))
SELECT doc_id, item FROM documents, items WHERE regexp_matches(text, trig) AND NOT regexp_matches(text, mention)""")
def omission_checklist(spark, d):
    items = [("licence_name", "[Ll]icen[sc]e", "(MIT|Apache|GNU|CC|BSD)"), ("token_value", "token", "[0-9a-f]{24,}"), ("line_break", "the", "\n")]
    return ops.checklist_gaps(table(spark, d, "documents"), items)


@R.add(f"WITH {SENTENCES}, g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(sentence, '^(The|A|Of|In) ')) AS n_hit FROM sentences GROUP BY 1 HAVING count(*) >= 8) SELECT doc_id, n, n_hit, round(n_hit / n, 4) AS ratio FROM g")
def hedging_ratio(spark, d):
    return ops.ratio_by_sentence(table(spark, d, "documents"), "^(The|A|Of|In) ")


@R.add("SELECT conv_id, turn, role, len(regexp_extract_all(text, '[0-9]+')) AS numbers, regexp_matches(lower(text), '(password|secret|token|key)') AS person_key FROM conversations WHERE regexp_matches(text, '[0-9]') OR regexp_matches(lower(text), '(password|secret|token|key)')")
def request_privacy(spark, d):
    c = table(spark, d, "conversations")
    key = F.lower("text").rlike("(password|secret|token|key)")
    return c.filter(F.col("text").rlike("[0-9]") | key).select("conv_id", "turn", "role", F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"), key.alias("person_key"))


@R.add("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '(example|site0|site1)') AS allowed, regexp_matches(html, '(?i)<script') AS has_script FROM pages""")
def output_quarantine(spark, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return table(spark, d, "pages").select("page_id", host.alias("host"), host.rlike("(example|site0|site1)").alias("allowed"), F.col("html").rlike("(?i)<script").alias("has_script"))


@R.add("SELECT doc_id, lang, source FROM documents WHERE NOT (regexp_matches(source, '^src1') OR contains(text, 'License') OR contains(text, 'licensed'))")
def quarantine_filter(spark, d):
    t = table(spark, d, "documents")
    return t.filter(~(F.col("source").rlike("^src1") | F.col("text").contains("License") | F.col("text").contains("licensed"))).select("doc_id", "lang", "source")
