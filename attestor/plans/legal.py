"""Queries of legal text: sentences with citations, dates and clauses are put after the texts of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import dates as D, legal as L, text as T
from attestor.operators import legal as ops

from ._base import Registry, table
from .arithmetic import PAIRS, pairs

R = Registry()
TODAY = "2020-01-01"

# One expression for both engines.
SAID = """CASE doc_id % 8
WHEN 0 THEN concat('대법원 ', 2000 + doc_id % 24, '. ', 1 + doc_id % 13, '. ', 1 + doc_id % 31, '. 선고 ', 2000 + doc_id % 22, '다', 100 + doc_id, ' 판결을 보면 명백하다. 대법원 2010. 1. 2. 선고 2009도', doc_id, ' 판결도 같다.')
WHEN 1 THEN concat('헌법재판소 2010. 5. ', 1 + doc_id % 28, '. 선고 2009헌바', doc_id, ' 결정이 있다. 사고는 2018년 3월 4일 발생하였다.')
WHEN 2 THEN concat('원고는 민법 제', doc_id % 3, '조 제2항과 「개인정보 보호법」 제15조의2, 형소법 제308조를 들었다.')
WHEN 3 THEN concat('서울고등법원 2018. 4. 5. 선고 2017다', doc_id, ' 판결은 확실하다. 서울고등법원 2018. 4. 5. 선고 2019나', doc_id, ' 판결은 다르다.')
WHEN 4 THEN concat('법제처 18-0123 해석과 중앙행심 2019-00', 100 + doc_id % 900, ' 재결, 국세청 훈령 제', doc_id, '호를 본다. 홍길동, 「계약의 해석」 참조.')
WHEN 5 THEN concat('2019. 3. ', 1 + doc_id % 31, '. 계약을 체결하였다. 2020년 2월 ', 1 + doc_id % 31, '일 대금을 지급하였다. 처분일: 2017. 7. 7.')
WHEN 6 THEN concat('[판례 확인 필요] 이 부분은 추후 보완. 블로그에 따르면 판례는 그렇다. 이는 확립된 판례이다. 문서 ', doc_id)
ELSE '통지를 2016. 6. 6. 받았고, 2016. 6. 6. 통지서를 보았다. 가능성이 있다.' END"""
DOCS = f"d AS (SELECT doc_id, concat(coalesce(text, ''), chr(10), {SAID}) AS text FROM documents)"


def said(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(f"concat(coalesce(text, ''), chr(10), {SAID})").alias("text"))


def _masked() -> str:
    """Steps of the claimed places: each pattern sees the text with what earlier ones took blanked."""
    steps, last = [], "d"
    for i, (kind, p) in enumerate(ops.CITATIONS.items()):
        steps.append(f"m{i} AS (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM {last})")
        steps.append(f"t{i} AS (SELECT doc_id, array_to_string([g[i] || repeat('#', coalesce(length(m[i]), 0)) FOR i IN range(1, len(g) + 1)], '') AS text FROM m{i})")
        steps.append(
            f"s{i} AS (SELECT doc_id, '{kind}' AS kind, m[i] AS value, (1 + list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0))::INT AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m{i} WHERE len(m) > 0))"
        )
        last = f"t{i}"
    return ", ".join(steps) + ", s AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(ops.CITATIONS))) + ")"


SPANS = f"{DOCS}, {_masked()}"
NUMBER = "regexp_extract(value, '([0-9]{2,4}[가-힣]{1,3}[0-9]{1,7})$', 1)"
LAW = "regexp_replace(regexp_extract(value, '^(.*?) ?제[0-9]+조', 1), '[「」 ]', '', 'g')"
CANON = f"""CASE WHEN kind IN ('CASE', 'CONSTITUTIONAL') THEN {NUMBER} WHEN kind = 'STATUTE' THEN CASE {LAW} WHEN '형소법' THEN '형사소송법' ELSE {LAW} END || ' ' ||
regexp_extract(value, '제([0-9]+)조', 1) || regexp_extract(value, '조(의[0-9]+)', 1) ELSE replace(value, ' ', '') END"""


@R.add(f"WITH {SPANS} SELECT doc_id, kind, value, start, (start + length(value))::INT AS stop, {CANON} AS canonical FROM s")
def legal_citations(spark, d):
    return ops.citations(said(spark, d))


@R.add(f"WITH {SPANS} SELECT doc_id, kind, {CANON} AS canonical, count(*) AS n, min(start) AS first FROM s GROUP BY ALL")
def citation_identity(spark, d):
    return ops.citation_identity(ops.citations(said(spark, d)))


YMD = r"(20[0-9][0-9]|19[0-9][0-9])\s?[.년]\s?([0-9]{1,2})\s?[.월]\s?([0-9]{1,2})"


def _day(c: str) -> str:
    return f"try_cast(regexp_extract({c}, '{YMD}', 1) || '-' || lpad(regexp_extract({c}, '{YMD}', 2), 2, '0') || '-' || lpad(regexp_extract({c}, '{YMD}', 3), 2, '0') AS DATE)"


FAMILY = " ".join(f"WHEN code IN ({', '.join(repr(c) for c in cs.split())}) THEN '{f}'" for f, cs in L.CODES.items())


@R.add(f"""WITH {SPANS}, p AS (SELECT *, {_day('value')} AS day, try_cast(regexp_extract({NUMBER}, '^[0-9]+') AS INT) AS year, regexp_extract({NUMBER}, '[가-힣]+') AS code, regexp_extract(value, '^([가-힣]+)', 1) AS court, kind IN ('CASE', 'CONSTITUTIONAL') AS dated FROM s),
q AS (SELECT *, CASE {FAMILY} END AS want, CASE WHEN court = '대법원' THEN 'SUPREME' WHEN court = '헌법재판소' THEN 'CONSTITUTIONAL' WHEN court LIKE '%법원' THEN 'LOWER' END AS have FROM p)
SELECT doc_id, start, value, 'DATE_NOT_ON_CALENDAR' AS rule_id FROM q WHERE dated AND day IS NULL UNION ALL SELECT doc_id, start, value, 'FUTURE_DATE' FROM q WHERE dated AND day > DATE '{TODAY}'
UNION ALL SELECT doc_id, start, value, 'FUTURE_CASE_YEAR' FROM q WHERE dated AND year > 2020 UNION ALL SELECT doc_id, start, value, 'DECIDED_BEFORE_FILED' FROM q WHERE dated AND year(day) < year
UNION ALL SELECT doc_id, start, value, 'COURT_CODE_MISMATCH' FROM q WHERE dated AND want <> have UNION ALL SELECT doc_id, start, value, 'ZERO_ARTICLE' FROM q WHERE kind = 'STATUTE' AND regexp_matches(value, '제0+(조|항|호)')""")
def citation_format(spark, d):
    return ops.format_violations(ops.citations(said(spark, d)), TODAY)


SENT = r"""sent AS (SELECT doc_id, unnest(range(len(p)))::INT AS pos, unnest(p) AS s FROM (SELECT doc_id, [trim(x) FOR x IN string_split(regexp_replace(text, '([^\s0-9][.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)) IF trim(x) <> ''] AS p FROM d))"""


def _first(c: str, rules: dict, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{k}'" for k, p in rules.items()) + f" ELSE {otherwise} END"


@R.add(f"""WITH {DOCS}, {SENT}, e AS (SELECT doc_id, pos, {_first('s', ops.EVENTS, "'GENERIC'")} AS kind, unnest(regexp_extract_all(s, '{ops.DAY}')) AS raw FROM sent) SELECT doc_id, pos, {_day('raw')} AS event_date, kind, raw FROM e WHERE {_day('raw')} IS NOT NULL""")
def event_extraction(spark, d):
    return ops.events(said(spark, d))


AFTER = rf"""w AS (SELECT doc_id, m[i] AS raw, right(g[i], 8) AS before, g[i + 1] AS after FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{ops.DAY}') AS m, string_split_regex(text, '{ops.DAY}') AS g FROM d) WHERE len(m) > 0)),
x AS (SELECT doc_id, {_day('raw')} AS day, coalesce({_first("left(after, 14)", ops.MEANINGS)}, {_first("before", ops.MEANINGS)}, {_first("string_split_regex(left(after, 80), '\\.\\s+|\\n')[1]", ops.MEANINGS)}, 'UNKNOWN') AS meaning FROM w)"""


@R.add(f"WITH {DOCS}, {AFTER} SELECT doc_id, meaning, count(DISTINCT day) AS n_dates, CASE WHEN count(DISTINCT day) = 1 THEN min(day) END AS reference_date FROM x WHERE day IS NOT NULL AND meaning NOT IN ('ENFORCEMENT', 'DOCUMENT', 'DECISION', 'UNKNOWN') GROUP BY ALL")
def reference_dates(spark, d):
    return ops.reference_dates(ops.dated_meanings(said(spark, d)))


OFFICIAL = "concat(2000 + doc_id % 22, '다', 100 + doc_id)"


@R.add(f"""WITH {DOCS}, {SENT}, n AS (SELECT doc_id, len(regexp_extract_all(text, '{ops.SUPREME}')) AS n_supreme FROM d), o AS (SELECT {OFFICIAL} AS case_number FROM documents WHERE doc_id % 16 = 0),
c AS (SELECT doc_id, pos, regexp_extract(unnest(regexp_extract_all(s, '{ops.CITATIONS['CASE']}')), '([0-9]{{2,4}}[가-힣]{{1,3}}[0-9]{{1,7}})$', 1) AS case_number FROM sent WHERE regexp_matches(s, '{ops.CERTAIN}') AND NOT regexp_matches(s, '{ops.HEDGED}'))
SELECT doc_id, pos, 'DRAFT_ARTIFACT' AS rule FROM sent WHERE regexp_matches(s, '{ops.DRAFT}') UNION ALL SELECT doc_id, pos, 'OVERCLAIM' FROM sent JOIN n USING (doc_id) WHERE regexp_matches(s, '{ops.SETTLED}') AND n_supreme < 2
UNION ALL SELECT doc_id, pos, 'AUTHORITY_RANK' FROM sent WHERE regexp_matches(s, '{ops.SECONDARY}') AND regexp_matches(s, '{ops.AUTHORITY}')
UNION ALL SELECT DISTINCT doc_id, pos, 'UNCERTAINTY_NOT_DISCLOSED' FROM c WHERE case_number NOT IN (SELECT case_number FROM o)""")
def assertion_rules(spark, d):
    official = table(spark, d, "documents").filter("doc_id % 16 = 0").select(F.expr(OFFICIAL).alias("case_number"))
    return ops.assertions(said(spark, d), official)


TERMS = """CASE doc_id % 6 WHEN 1 THEN concat('제1조(목적) 이 계약은 공급을 정한다', chr(10), '제2조(대금) 대금은 ', doc_id, '원이다', chr(10), '제3조(기간) 기간은 1년이다')
WHEN 2 THEN '첨부 제2조의 기간을 따른다.' WHEN 3 THEN '첨부 제2조의 대금을 지급한다.' WHEN 4 THEN '계약서 제9조의 벌칙이 있다.' WHEN 5 THEN '민법 제2조의 신의칙은 다르다. 약관 제1조의 공급은 같다.' ELSE '제1조(하나) 조항이 하나뿐이다' END"""


# Contracts have three clauses; a document of another kind has one line that refers to them, known by its number alone.
@R.add("""SELECT a.doc_id, b.doc_id AS source_id, '2' AS clause, '기간' AS concept, '3' AS candidates FROM documents a JOIN documents b ON a.doc_id // 30 = b.doc_id // 30 AND a.doc_id % 6 = 2 AND b.doc_id % 6 = 1""")
def clause_references(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 30).alias("project"), F.expr(TERMS).alias("text"))
    return ops.clause_mismatches(docs, "project")


PERIOD_TEXT = """concat(year(a), '. ', month(a), '. ', day(a), '.부터 ', year(b), '. ', month(b), '. ', day(b), '.까지 ', CASE o_orderkey % 3 WHEN 0 THEN concat(days + o_orderkey % 4, '일') WHEN 1 THEN concat(o_orderkey % 30, '개월') ELSE concat(o_orderkey % 4, '년') END, '이 지났다')"""


@R.add(f"""WITH {PAIRS}, t AS (SELECT o_orderkey, a, b, (b - a)::INT AS exclusive, ['일', '개월', '년'][o_orderkey % 3 + 1] AS unit, CASE o_orderkey % 3 WHEN 0 THEN (b - a) + o_orderkey % 4 WHEN 1 THEN o_orderkey % 30 ELSE o_orderkey % 4 END::INT AS stated FROM p),
e AS (SELECT *, CASE WHEN unit <> '일' THEN (a + to_months(stated * CASE unit WHEN '년' THEN 12 ELSE 1 END))::DATE - 1 END AS earliest FROM t)
SELECT o_orderkey, unit, stated, exclusive + 1 AS inclusive, exclusive, earliest, CASE WHEN unit = '일' THEN stated IN (exclusive, exclusive + 1) ELSE b >= earliest END AS ok FROM e""")
def period_checks(spark, d):
    rows = pairs(spark, d).withColumn("days", F.datediff("b", "a")).select("o_orderkey", F.expr(PERIOD_TEXT).alias("text"))
    return ops.period_checks(rows, "o_orderkey", "text")


LAW_TEXTS = {
    "원고는 공공기관의 정보공개에 관한 법률": "공공기관의 정보공개에 관한 법률", "폭언을 하였다는 이유로 군인사법": "군인사법", "또한 형사 소송법": "형사소송법", "그는 「개인정보 보호법」": "개인정보보호법",
    "피고가 위반한 국가를 당사자로 하는 계약에 관한 법률": "국가를 당사자로 하는 계약에 관한 법률", "형소법": "형사소송법", "학교폭력예방 및 대책에 관한 법률": "학교폭력예방 및 대책에 관한 법률", "형법 및 민법": "민법",
}
PICK = "({k} % " + str(len(LAW_TEXTS)) + " + 1)"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@R.add(f"SELECT p_partkey, ({_list(LAW_TEXTS.values())})[{PICK.format(k='p_partkey')}] AS law, p_size || CASE WHEN p_partkey % 2 = 0 THEN '의' || p_partkey ELSE '' END AS article FROM part")
def law_names(spark, d):
    law = F.element_at(F.array(*(F.lit(t) for t in LAW_TEXTS)), F.expr(PICK.format(k="p_partkey")).cast("int"))
    number = F.expr("CASE WHEN p_partkey % 4 = 0 THEN concat('제', p_size, '조의', p_partkey) WHEN p_partkey % 4 = 2 THEN concat(p_size, '-', p_partkey) ELSE concat('제 0', p_size, ' 조') END")
    return table(spark, d, "part").select("p_partkey", L.law_name(law).alias("law"), L.article(number).alias("article"))


@R.add(f"""SELECT o_orderkey, year(o_orderdate)::INT AS year, ['다', '가합', '쀍', '헌바'][o_orderkey % 4 + 1] AS code, (o_orderkey % 10000000)::INT AS serial, o_orderkey % 4 <> 2 AND year(o_orderdate) <= 1997 AS possible FROM orders""")
def case_number_parts(spark, d):
    number = F.concat(F.lit("사건 "), F.year("o_orderdate").cast("string"), F.lit(" "), F.element_at(F.array(*(F.lit(c) for c in ("다", "가합", "쀍", "헌바"))), (F.col("o_orderkey") % 4 + 1).cast("int")), (F.col("o_orderkey") % 10000000).cast("string"))
    year, code, serial = L.case_parts(number)
    return table(spark, d, "orders").select("o_orderkey", year.alias("year"), code.alias("code"), serial.alias("serial"), L.case_possible(number, 1997).alias("possible"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def korean_dates(spark, d):
    day = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN concat(year(o_orderdate), '년 2월 30일') WHEN o_orderkey % 2 = 0 THEN concat(year(o_orderdate), '년 ', month(o_orderdate), '월 ', day(o_orderdate), '일에') ELSE concat('일자: ', year(o_orderdate), '. ', month(o_orderdate), '. ', day(o_orderdate), '.') END")
    return table(spark, d, "orders").select("o_orderkey", D.parse_date(day).alias("day"))


@R.add("""WITH v AS (SELECT p_partkey, (p_partkey % 9 + 1) * 100000000 + (p_size % 9 + 1) * 10000000 + (p_partkey % 7 + 1) * 1000000 AS v FROM part) SELECT p_partkey, v::BIGINT AS words_value, (v + 1000)::BIGINT AS digits_value, 1000::BIGINT AS difference FROM v WHERE p_partkey % 4 = 0""")
def words_and_digits(spark, d):
    digit = lambda c: F.substring(F.lit("일이삼사오육칠팔구"), c.cast("int"), F.lit(1))
    a, b, c = F.col("p_partkey") % 9 + 1, F.col("p_size") % 9 + 1, F.col("p_partkey") % 7 + 1
    v = (a * 100000000 + b * 10000000 + c * 1000000 + F.when(F.col("p_partkey") % 4 == 0, 1000).otherwise(0)).cast("long")
    text = F.concat(F.lit("금 "), digit(a), F.lit("억"), digit(b), F.lit("천"), digit(c), F.lit("백만원("), F.regexp_replace(F.format_number(v, 0), r"\.0*$", ""), F.lit("원)"))
    return ops.words_against_digits(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


TAGS = "".join(chr(L.TAG_BASE + ord(c)) for c in "abcdefghijklmnopqrstuvwxyz0123456789 -")


@R.add("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'order ' || p_partkey ELSE '' END AS hidden FROM part")
def hidden_tags(spark, d):
    planted = F.translate(F.concat(F.lit("order "), F.col("p_partkey").cast("string")), "abcdefghijklmnopqrstuvwxyz0123456789 -", TAGS)
    text = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, planted).otherwise(""))
    return table(spark, d, "part").select("p_partkey", L.hidden_tags(text).alias("hidden"))


@R.add("SELECT p_partkey, 'x' || chr((44032 + ((p_partkey % 19) * 21 + p_size % 21) * 28 + p_partkey % 28)::INT) || '갘ㅋ' AS text FROM part")
def compose_letters(spark, d):
    at = lambda s, i: F.substring(F.lit(s), (i + 1).cast("int"), F.lit(1))
    final = F.when(F.col("p_partkey") % 28 > 0, at(L.FINAL, F.col("p_partkey") % 28 - 1)).otherwise("")
    text = F.concat(F.lit("x"), at(L.INITIAL, F.col("p_partkey") % 19), at(L.MEDIAL, F.col("p_size") % 21), final, F.lit("ㄱㅏㅋㅋ"))
    return table(spark, d, "part").select("p_partkey", L.compose_letters(text).alias("text"))


@R.add("SELECT doc_id, 'hex' AS kind, 'hidden nos ' || doc_id AS decoded FROM documents UNION ALL SELECT doc_id, 'base64', 'a secret note that is long enough ' || doc_id FROM documents")
def decoded_tokens(spark, d):
    planted = table(spark, d, "documents").select("doc_id", F.expr("concat('see ', lower(hex(concat('hidden nos ', doc_id))), ' or ', base64(cast(concat('a secret note that is long enough ', doc_id) as binary)), ' and ffffffffffffffffffffffffff')").alias("text"))
    from attestor.operators import text as text_ops

    found = text_ops.encoding_scan(planted).filter(F.col("kind").isin("hex", "base64"))
    out = F.when(F.col("kind") == "hex", T.decoded(F.col("token"), "hex")).otherwise(T.decoded(F.col("token"), "base64"))
    return found.select("doc_id", "kind", out.alias("decoded")).filter("decoded is not null")


@R.add("WITH t AS (SELECT unnest(['계약', '약해', '해지', '통지', '지서', 'abc', 'p' || p_partkey]) AS token FROM part) SELECT token, count(*) AS n FROM t GROUP BY 1")
def hangul_tokens(spark, d):
    text = F.concat(F.lit("계약해지 통지서 을 ABC p"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(F.explode(T.tokens(text)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@R.add("SELECT doc_id, md5(replace(replace(replace(text, ' the ', ''), '***', ''), '!!', '')) AS digest FROM documents")
def strip_observed_spans(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.remove_observed(F.col("text"), ["!!", " the ", "***", "!!"]).cast("binary")).alias("digest"))


QUOTES = {
    "사회통념상 타당성을 잃은 경우 3 항은 무효이다": "delete|현저하게||DEGREE", "사회통념상 현저하게 타당성을 잃은 경우 3 항은 무효가 아니다": "replace|무효이다|무효가 아니다|NEGATION", "사회통념상 현저하게 타당성을 잃은 경우 5 항은 무효이다": "replace|3|5|QUANTITY",
    "사회통념상 현저하게 정당성을 잃은 경우 3 항은 무효이다": "replace|타당성을|정당성을|", "사회통념상 현저하게 타당성을 잃은 경우, 3 항은 무효이다": None,
}


@R.add(f"""WITH v AS (SELECT p_partkey, ({_list(v or '' for v in QUOTES.values())})[p_partkey % {len(QUOTES)} + 1] AS v FROM part) SELECT p_partkey, string_split(v, '|')[1] AS op, string_split(v, '|')[2] AS before, string_split(v, '|')[3] AS after, string_split(v, '|')[4] AS kinds FROM v WHERE v <> ''""")
def quote_changes(spark, d):
    quoted = F.element_at(F.array(*(F.lit(q) for q in QUOTES)), (F.col("p_partkey") % len(QUOTES) + 1).cast("int"))
    return ops.quote_changes(table(spark, d, "part").select("p_partkey", F.lit("사회통념상 현저하게 타당성을 잃은 경우 3 항은 무효이다").alias("a"), quoted.alias("b")), "p_partkey", "a", "b")


# Every project of ten documents agrees on its sum unless its number is divisible by 3; only even documents name the day.
FACTS = "concat(coalesce(text, ''), chr(10), '계약금액: ', 1 + doc_id // 10 + CASE WHEN (doc_id // 10) % 3 = 0 AND doc_id % 10 = 4 THEN 1 ELSE 0 END, '억 5,000만원', chr(10), CASE WHEN doc_id % 2 = 0 THEN '납기 : 2020. 3. 1.' ELSE '납기 미정' END)"


@R.add("""SELECT doc_id // 10 AS project, '계약금액' AS label, count(*) AS n_docs, CASE WHEN (doc_id // 10) % 3 = 0 AND bool_or(doc_id % 10 = 4) THEN 2 ELSE 1 END::BIGINT AS n_values, NOT ((doc_id // 10) % 3 = 0 AND bool_or(doc_id % 10 = 4)) AS agree FROM documents GROUP BY doc_id // 10 HAVING count(*) > 1
UNION ALL SELECT doc_id // 10, '납기', count(*), 1, TRUE FROM documents WHERE doc_id % 2 = 0 GROUP BY 1 HAVING count(*) > 1""")
def linked_observations(spark, d):
    text = FACTS.replace("doc_id // 10", "floor(doc_id / 10)")
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 10).alias("project"), F.expr(text).alias("text"))
    return ops.linked_observations(ops.labelled_facts(docs, ["계약금액", "납기"], "doc_id", "project"), "project")


EXHIBITED = "concat('갑 제', doc_id % 50 + 1, '호증과 을제2호증에 의하면 사실이다. 갑 제', doc_id % 50 + 1, '호증, 갑제', doc_id % 50 + 1, ' 호증은 같다. [당사자명]은 ○○○와 ', CASE WHEN doc_id % 2 = 0 THEN '____에 산다.' ELSE 'xxx 이다.' END)"


@R.add("""SELECT doc_id, 0 AS pos, '갑' AS side, (doc_id % 50 + 1)::INT AS number FROM documents UNION ALL SELECT doc_id, 0, '을', 2 FROM documents UNION ALL SELECT doc_id, 1, '갑', (doc_id % 50 + 1)::INT FROM documents""")
def evidence_statements(spark, d):
    return ops.evidence_statements(table(spark, d, "documents").select("doc_id", F.expr(EXHIBITED).alias("text")))


@R.add("""SELECT doc_id, unnest(['BRACKET', 'CIRCLES', CASE WHEN doc_id % 2 = 0 THEN 'BLANK' ELSE 'LATIN' END]) AS kind, 1 AS n FROM documents""")
def template_residue(spark, d):
    return ops.placeholders(table(spark, d, "documents").select("doc_id", F.expr(EXHIBITED).alias("text")))


@R.add(f"""WITH {PAIRS} SELECT o_orderkey, round(least(money::DOUBLE * 0.001 * greatest(0, (b - a) - 60), money::DOUBLE * 0.3), 6) AS penalty, round(money::DOUBLE / sum(money) OVER (PARTITION BY year(a), month(a))::DOUBLE, 8) AS share FROM p""")
def penalty_and_share(spark, d):
    m, p = F.col("money").cast("double"), pairs(spark, d).withColumn("month", F.trunc("a", "month"))
    # Sums first: a month's rows need not meet in one task.
    total = p.groupBy("month").agg(F.sum("money").cast("double").alias("total"))
    share = m / F.col("total")
    return p.join(total, "month").select("o_orderkey", F.round(D.delay_penalty(m, F.lit(0.001), F.datediff("b", "a") - 60, 0.3), 6).alias("penalty"), F.round(share, 8).alias("share"))


@R.add("""WITH v AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS yes FROM lineitem GROUP BY 1) SELECT l_suppkey, n, yes, yes * 2 > n AS majority, yes * 2 >= n AS half, yes * 3 >= n * 2 AS two_thirds, yes * 4 > n AS strict_quarter FROM v""")
def vote_rules(spark, d):
    v = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("yes"))
    rule = lambda share, strict: D.passes(F.col("yes"), F.col("n"), share, strict)
    return v.select("l_suppkey", "n", "yes", rule((1, 2), True).alias("majority"), rule((1, 2), False).alias("half"), rule((2, 3), False).alias("two_thirds"), rule((1, 4), True).alias("strict_quarter"))
