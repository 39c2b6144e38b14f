"""Extraction from legal text: citations by type, events, reference dates, periods, assertions, references to clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import dates as D, legal as L, text as T

# A written date, and the forms of citations in the order in which they claim their place.
DAY = r"(?:19|20)[0-9]{2}\s?[.년]\s?[0-9]{1,2}\s?[.월]\s?[0-9]{1,2}\s?[.일]"
CITATIONS = {
    "CONSTITUTIONAL": rf"헌법재판소 {DAY} (?:선고|자) [0-9]{{4}}헌[가-힣][0-9]{{1,5}}",
    "CASE": rf"(?:대법원|[가-힣]{{2,8}}법원) {DAY} (?:선고|자) [0-9]{{2,4}}[가-힣]{{1,3}}[0-9]{{1,7}}",
    "ADMIN_APPEAL": r"(?:중앙)?행심 ?[0-9]{4}-[0-9]{3,6}",
    "INTERPRETATION": r"법제처 ?[0-9]{2}-[0-9]{4}",
    "ADMIN_RULE": r"[가-힣]{2,20} (?:훈령|예규|고시) 제[0-9]+(?:-[0-9]+)?호",
    "STATUTE": r"(?:「[^」\n]{2,60}」|[가-힣]{1,20}(?:법률|법|시행령|시행규칙)) ?제[0-9]+조(?:의[0-9]+)?(?: ?제[0-9]+항)?(?: ?제[0-9]+호)?",
    "LITERATURE": r"[가-힣]{2,4}, 「[^」\n]{2,60}」",
}
# Kinds of events and meanings of dates, by the first rule that matches.
EVENTS = {
    "CONTRACT": r"계약(?:을)?\s*체결|약정|합의", "TERMINATION": "해지|해제|종료|파기", "PAYMENT": "지급|송금|입금|변제", "INCORPORATION": "설립|법인등기|개업",
    "FILING": "제출|접수|신청|고소|고발|기소", "DECISION": "선고|판결|결정|처분", "INCIDENT": "사고|발생|폭행|상해|침해|위반",
}
MEANINGS = {
    "DISPOSITION": "처분|징계|해임|파면|강등|정직|감봉|견책|부과", "NOTICE": "통지|송달|고지|통보|수령", "APPLICATION": "신청|청구|제기|접수|제출",
    "CONDUCT": "사고|발생|행위|위반|폭행|근무|복무|적발|내원|진료|수술|투약|입원|발병|사망", "CONTRACT": "계약|합의|약정|체결", "DECISION": "선고|판결|결정|재결|의결",
    "HEARING": r"청문|의견\s*제출|진술", "ENFORCEMENT": "시행|공포|발령|개정", "DOCUMENT": "작성",
}
NO_REFERENCE = ("ENFORCEMENT", "DOCUMENT", "DECISION", "UNKNOWN")
# Forms of drafts, certainty, hedges, settled doctrine, secondary sources and claims of authority.
DRAFT = r"\[[^\]\n]{0,30}(추가|보완|확인|검증|삽입|수정|작성)\s*(필요|요망|요)?[^\]\n]{0,10}\]|(인용|출처|근거|판례|조문)\s*(검증|확인)\s*(필요|요망|바람)|\b(TODO|TBD|FIXME)\b|●{3,}|추후\s*(보완|확인|기재|삽입)"
CERTAIN = r"명백(하|히)|확실(하|히)|틀림없|의문의\s*여지가\s*없|당연히|필연적으로|확정적으로|다툼의\s*여지가\s*없"
HEDGED = r"가능성|것으로\s*보인다|여지가\s*있|다툴\s*수\s*있|일\s*수\s*있|추정된다|불확실|확인이\s*필요|미확인|검토가\s*필요"
SETTLED = r"확립된\s*판례|확고한\s*(판례|입장|태도)|일관(되게|된)\s*판시|판례의\s*확립된\s*법리|통설\s*판례"
SECONDARY = r"블로그|네이버\s*지식|카페\s*글|보도자료|언론\s*보도|기사에\s*따르면|위키|챗봇"
AUTHORITY = "법리(는|상)|판례(는|상)|법령(은|상)|대법원(은|의)|조문(은|상)"
SUPREME = rf"대법원 {DAY} 선고"
CLAUSE = r"^제([0-9]+조(?:의[0-9]+)?)\s?\(([^)]*)\)(.*)$"
POINTED = r"(?:첨부|별첨|계약서|약정서|합의서|협약서|정관|약관|규약)\s?제([0-9]+조(?:의[0-9]+)?)의?\s([가-힣]{2,10}?)(?:을|를|이|가|은|는|에)?(?:[\s.]|$)"
PERIOD = rf"({DAY})\s*부터\s*({DAY})\s*까지\s*([0-9]{{1,4}})(일|개월|년)"


def claim_spans(docs: DataFrame, patterns: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(key, kind, value, start, stop): what each pattern matches, in order; what one took no later one can touch.

    Taken places are blanked before the next pattern looks, so a text is read once per pattern, however many matches it
    has. Places count from 1; null texts have none.
    """
    t = docs.filter(F.col("text").rlike("|".join(f"(?:{p})" for p in patterns.values()))).select(key, F.col("text").alias("_rest"))
    for i, p in enumerate(patterns.values()):
        t = t.withColumn(f"_m{i}", F.regexp_extract_all("_rest", F.lit(p), F.lit(0))).withColumn(f"_g{i}", F.split("_rest", p))
        blank = lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit("\u0001"), F.length(m)), F.lit("")))
        t = t.withColumn("_rest", F.array_join(F.zip_with(f"_g{i}", f"_m{i}", blank), ""))
    kind_type = "array<struct<kind:string,value:string,start:int,stop:int>>"

    def placed(i, kind):
        def step(s, x):
            start = s["at"] + x["gap"]
            stop = start + F.length(x["v"])
            new = F.struct(F.lit(kind).alias("kind"), x["v"].alias("value"), start.alias("start"), stop.alias("stop"))
            return F.struct(stop.alias("at"), F.concat(s["out"], F.array(new)).alias("out"))

        pairs = F.zip_with(f"_m{i}", F.slice(f"_g{i}", 1, F.size(f"_m{i}")), lambda v, g: F.struct(v.alias("v"), F.length(g).alias("gap")))
        return F.aggregate(pairs, F.struct(F.lit(1).alias("at"), F.expr(f"cast(array() as {kind_type})").alias("out")), step, lambda s: s["out"])

    return t.select(key, F.inline(F.flatten(F.array(*(placed(i, k) for i, k in enumerate(patterns))))))


def citations(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, value, start, stop, canonical): citations of seven kinds; canonical names what is cited, however it is written."""
    s = claim_spans(docs, CITATIONS)
    case = F.regexp_extract("value", "([0-9]{2,4}[가-힣]{1,3}[0-9]{1,7})$", 1)
    law = F.concat_ws(" ", L.law_name(F.regexp_extract("value", r"^(.*?)\s?제[0-9]+조", 1)), L.article(F.regexp_extract("value", "(제[0-9]+조(?:의[0-9]+)?)", 1)))
    other = F.replace("value", F.lit(" "), F.lit(""))
    return s.withColumn("canonical", F.when(F.col("kind").isin("CASE", "CONSTITUTIONAL"), case).when(F.col("kind") == "STATUTE", law).otherwise(other))


def citation_identity(cited: DataFrame) -> DataFrame:
    """(doc_id, kind, canonical, n, first): one row per cited thing and document."""
    return cited.groupBy("doc_id", "kind", "canonical").agg(F.count("*").alias("n"), F.min("start").alias("first"))


def format_violations(cited: DataFrame, today: str) -> DataFrame:
    """(doc_id, start, rule_id, value): citations that cannot be: dates off the calendar or to come, a decision before its filing, a mark of another court, article 0."""
    now = F.lit(today).cast("date")
    dated = F.col("kind").isin("CASE", "CONSTITUTIONAL")
    day = D.parse_date(F.col("value"))
    year, code, _ = L.case_parts(F.regexp_extract("value", "([0-9]{2,4}[가-힣]{1,3}[0-9]{1,7})$", 1))
    court = L.court_family(F.regexp_extract("value", "^([가-힣]+)", 1))
    rules = {
        "DATE_NOT_ON_CALENDAR": dated & day.isNull(), "FUTURE_DATE": dated & (day > now), "FUTURE_CASE_YEAR": dated & (year > F.year(now)), "DECIDED_BEFORE_FILED": dated & (F.year(day) < year),
        "COURT_CODE_MISMATCH": dated & (court != L.code_family(code)), "ZERO_ARTICLE": (F.col("kind") == "STATUTE") & F.col("value").rlike("제0+(조|항|호)"),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    return cited.select("doc_id", "start", "value", F.explode(broken).alias("rule_id"))


def events(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, event_date, kind, raw): each date of the calendar in a sentence, with the kind of event that the sentence tells."""
    s = docs.select("doc_id", F.posexplode(T.legal_sentences(F.col("text"))).alias("pos", "s")).filter(F.col("s").rlike(DAY))
    s = s.select("doc_id", "pos", L.first_match(F.col("s"), EVENTS, "GENERIC").alias("kind"), F.explode(F.regexp_extract_all("s", F.lit(DAY), F.lit(0))).alias("raw"))
    return s.withColumn("event_date", D.parse_date(F.col("raw"))).filter("event_date is not null").select("doc_id", "pos", "event_date", "kind", "raw")


def dated_meanings(docs: DataFrame) -> DataFrame:
    """(doc_id, day, meaning): each date of the calendar and what the words close after it, before it, or later in its sentence say it is."""
    t = docs.filter(F.col("text").rlike(DAY)).select("doc_id", F.regexp_extract_all("text", F.lit(DAY), F.lit(0)).alias("m"), F.split("text", DAY).alias("g"))
    around = F.transform("m", lambda v, i: F.struct(v.alias("raw"), F.right(F.get("g", i), F.lit(8)).alias("before"), F.get("g", i + 1).alias("after")))
    t = t.select("doc_id", F.inline(around))
    sentence = F.get(F.split(F.substring("after", 1, 80), r"\.\s+|\n"), F.lit(0))
    meaning = F.coalesce(L.first_match(F.substring("after", 1, 14), MEANINGS), L.first_match(F.col("before"), MEANINGS), L.first_match(sentence, MEANINGS), F.lit("UNKNOWN"))
    return t.select("doc_id", D.parse_date(F.col("raw")).alias("day"), meaning.alias("meaning")).filter("day is not null")


def reference_dates(dated: DataFrame) -> DataFrame:
    """(doc_id, meaning, n_dates, reference_date): candidates by meaning; a reference date only where there is one date of that meaning."""
    g = dated.filter(~F.col("meaning").isin(*NO_REFERENCE)).groupBy("doc_id", "meaning").agg(F.countDistinct("day").alias("n_dates"), F.min("day").alias("d"))
    return g.select("doc_id", "meaning", "n_dates", F.when(F.col("n_dates") == 1, F.col("d")).alias("reference_date"))


def period_checks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit, stated, inclusive, exclusive, earliest, ok) of the first `A부터 B까지 N일` of each text.

    Days may count the first day or not; months and years must not reach beyond B, counting the first day. Reversed dates
    and dates off the calendar give no row.
    """
    part = lambda i: F.regexp_extract(text, PERIOD, i)
    p = rows.filter(F.col(text).rlike(PERIOD)).select(key, D.parse_date(part(1)).alias("a"), D.parse_date(part(2)).alias("b"), part(3).cast("int").alias("stated"), part(4).alias("unit"))
    p = p.filter("a is not null and b >= a").withColumn("exclusive", F.datediff("b", "a")).withColumn("inclusive", F.col("exclusive") + 1)
    months = F.col("stated") * F.when(F.col("unit") == "년", 12).otherwise(1)
    p = p.withColumn("earliest", F.when(F.col("unit") != "일", F.date_add(F.add_months("a", months), -1)))
    ok = F.when(F.col("unit") == "일", (F.col("stated") == F.col("inclusive")) | (F.col("stated") == F.col("exclusive"))).otherwise(F.col("b") >= F.col("earliest"))
    return p.select(key, "unit", "stated", "inclusive", "exclusive", "earliest", ok.alias("ok"))


def assertions(docs: DataFrame, official: DataFrame) -> DataFrame:
    """(doc_id, pos, rule): left-over drafts, settled doctrine on fewer than two supreme decisions, secondary sources as authority, and certainty about a case that official(case_number) lacks."""
    s = docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(SUPREME), F.lit(0))).alias("n_supreme"), F.posexplode(T.legal_sentences(F.col("text"))).alias("pos", "s"))
    has = lambda p: F.col("s").rlike(p)
    rules = {"DRAFT_ARTIFACT": has(DRAFT), "OVERCLAIM": has(SETTLED) & (F.col("n_supreme") < 2), "AUTHORITY_RANK": has(SECONDARY) & has(AUTHORITY)}
    plain = s.select("doc_id", "pos", F.explode(F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())).alias("rule"))
    sure = s.filter(has(CERTAIN) & ~has(HEDGED)).select("doc_id", "pos", F.explode(F.regexp_extract_all("s", F.lit(CITATIONS["CASE"]), F.lit(0))).alias("c"))
    sure = sure.withColumn("case_number", F.regexp_extract("c", "([0-9]{2,4}[가-힣]{1,3}[0-9]{1,7})$", 1)).join(official.select("case_number"), "case_number", "left_anti")
    return plain.unionByName(sure.select("doc_id", "pos", F.lit("UNCERTAINTY_NOT_DISCLOSED").alias("rule")).distinct())


def clause_index(docs: DataFrame, scope: str) -> DataFrame:
    """(scope, source_id, clause, body): lines that open a clause, of documents with two or more; the longest of several with one number."""
    line = docs.select(scope, F.col("doc_id").alias("source_id"), F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(CLAUSE))
    c = line.select(scope, "source_id", L.article(F.regexp_extract("line", CLAUSE, 1)).alias("clause"), F.concat_ws(" ", F.regexp_extract("line", CLAUSE, 2), F.regexp_extract("line", CLAUSE, 3)).alias("body"))
    c = c.groupBy(scope, "source_id", "clause").agg(F.max(F.struct(F.length("body").alias("n"), "body"))["body"].alias("body"))
    many = c.groupBy(scope, "source_id").agg(F.count("*").alias("n")).filter("n >= 2").select(scope, "source_id")
    return c.join(many, [scope, "source_id"], "left_semi")


def clause_mismatches(docs: DataFrame, scope: str) -> DataFrame:
    """(doc_id, source_id, clause, concept, candidates): references to an attached text's clause that does not speak of what is said of it.

    Sources are the other documents of the same scope (a project); references meet clauses by number, never document by
    document. candidates: the clauses of that source that do speak of it. Articles of laws have no pointer and are left alone.
    """
    index = clause_index(docs, scope)
    found = docs.filter(F.col("text").rlike(POINTED)).select(scope, "doc_id", F.explode(F.regexp_extract_all("text", F.lit(POINTED), F.lit(0))).alias("r"))
    refs = found.select(scope, "doc_id", L.article(F.regexp_extract("r", POINTED, 1)).alias("clause"), F.regexp_extract("r", POINTED, 2).alias("concept")).distinct()
    bad = refs.join(index, [scope, "clause"]).filter((F.col("doc_id") != F.col("source_id")) & ~F.col("body").contains(F.col("concept"))).drop("body")
    others = index.select(scope, "source_id", F.col("clause").alias("other"), "body")
    hits = bad.join(others, [scope, "source_id"]).filter((F.col("other") != F.col("clause")) & F.col("body").contains(F.col("concept")))
    hits = hits.groupBy("doc_id", "source_id", "clause", "concept").agg(F.array_join(F.sort_array(F.collect_list("other")), ",").alias("candidates"))
    return bad.drop(scope).join(hits, ["doc_id", "source_id", "clause", "concept"], "left")


def words_against_digits(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words_value, digits_value, difference): amounts written in words and in digits beside them that differ."""
    p = r"([일이삼사오육칠팔구십백천만억조0-9 ]*[일이삼사오육칠팔구십백천만억조])원?정?\s?\(([0-9][0-9,]*)원?\)"
    pair = rows.filter(F.col(text).rlike(p)).select(key, F.explode(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("x"))
    v = pair.select(key, L.amount_words(F.regexp_extract("x", p, 1)).alias("words_value"), F.replace(F.regexp_extract("x", p, 2), F.lit(","), F.lit("")).try_cast("long").alias("digits_value"))
    return v.filter("words_value <> digits_value").withColumn("difference", F.col("digits_value") - F.col("words_value"))


# Words whose change alters what a quotation says, by class.
CHANGES = {
    "DEGREE": "현저|상당|명백|중대|매우|극히|다소|약간|전혀|반드시|항상|언제나|오로지|오직|특히", "NEGATION": "아니|않|못|없|불가|금지", "MODALITY": "수있|하여야|해야|하도록|하여서는|할것|하지아니할",
    "PROVISION_QUALIFIER": "단서|본문|전단|후단|제[0-9]+항|제[0-9]+호|각호", "QUANTITY": "[0-9]+",
}
EXHIBIT = r"(갑|을)\s?제\s?([0-9]{1,3})\s?호증"
PLACEHOLDERS = {"BRACKET": r"\[(당사자명|성명|주소|날짜|금액|회사명)\]", "CIRCLES": "[○◯]{2,}", "LATIN": r"\b[xX]{3,}\b", "BLANK": "_{4,}"}


def quote_changes(pairs: DataFrame, key: str, original: str, quoted: str) -> DataFrame:
    """(key, op, before, after, kinds): changed runs of words between an original and its quotation, with the classes of words that only one side has.

    Differences of blanks and marks alone are none; kinds is empty where the meaning stays.
    """
    from .similarity import word_diff

    bare = lambda c: F.regexp_replace(c, r"[\s\"'“”‘’.,·「」『』()\[\]<>《》]", "")
    c = pairs.select(key, F.explode(word_diff(original, quoted)).alias("c")).select(key, "c.op", F.col("c.a").alias("before"), F.col("c.b").alias("after"))
    c = c.filter(bare(F.col("before")) != bare(F.col("after")))
    words = lambda side, p: F.array_sort(F.array_distinct(F.regexp_extract_all(bare(F.col(side)), F.lit(p), F.lit(0))))
    kinds = F.filter(F.array(*(F.when(words("before", p) != words("after", p), F.lit(k)) for k, p in CHANGES.items())), lambda k: k.isNotNull())
    return c.select(key, "op", "before", "after", F.array_join(kinds, ",").alias("kinds"))


def labelled_facts(docs: DataFrame, labels: list[str], *keys: str) -> DataFrame:
    """(keys, label, raw, amount, day): lines `label: value`, with the won or the day that the value tells."""
    from attestor.functions.parse import korean_amount

    p = rf"^\s*({'|'.join(labels)})\s*[:：]\s*(.+)$"
    line = docs.select(*keys, F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(p))
    f = line.select(*keys, F.regexp_extract("line", p, 1).alias("label"), F.trim(F.regexp_extract("line", p, 2)).alias("raw"))
    return f.withColumn("amount", korean_amount(F.col("raw"))).withColumn("day", D.parse_date(F.col("raw")))


def linked_observations(facts: DataFrame, scope: str) -> DataFrame:
    """(scope, label, n_docs, n_values, agree): the facts of one label in a project; several values contradict each other."""
    value = F.coalesce(F.col("amount").cast("string"), F.col("day").cast("string"), F.col("raw"))
    g = facts.groupBy(scope, "label").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct(value).alias("n_values"))
    return g.filter("n_docs > 1").withColumn("agree", F.col("n_values") == 1)


def evidence_statements(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, side, number): each exhibit that a sentence rests on, once a sentence."""
    s = docs.select("doc_id", F.posexplode(T.legal_sentences(F.col("text"))).alias("pos", "s")).filter(F.col("s").rlike(EXHIBIT))
    e = s.select("doc_id", "pos", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(EXHIBIT), F.lit(0)))).alias("e"))
    return e.select("doc_id", "pos", F.regexp_extract("e", EXHIBIT, 1).alias("side"), F.regexp_extract("e", EXHIBIT, 2).cast("int").alias("number")).distinct()


def placeholders(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, n): places of a template that nobody filled in."""
    n = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).alias("n")) for k, p in PLACEHOLDERS.items()))
    return docs.filter("text is not null").select("doc_id", F.inline(n)).filter("n > 0")
