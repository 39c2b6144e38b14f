"""Column functions for Korean legal text: names of laws, articles, case numbers, amounts in words, hidden characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names of laws.
ALIASES = {
    "형소법": "형사소송법", "민소법": "민사소송법", "행소법": "행정소송법", "국배법": "국가배상법", "근기법": "근로기준법", "헌법": "대한민국헌법", "개인정보법": "개인정보 보호법",
    "정통망법": "정보통신망 이용촉진 및 정보보호 등에 관한 법률", "정보통신망법": "정보통신망 이용촉진 및 정보보호 등에 관한 법률", "부경법": "부정경쟁방지 및 영업비밀보호에 관한 법률",
    "국가계약법": "국가를 당사자로 하는 계약에 관한 법률", "지방계약법": "지방자치단체를 당사자로 하는 계약에 관한 법률", "공정거래법": "독점규제 및 공정거래에 관한 법률",
    "성폭력처벌법": "성폭력범죄의 처벌 등에 관한 특례법", "특정범죄가중법": "특정범죄 가중처벌 등에 관한 법률", "학교폭력예방법": "학교폭력예방 및 대책에 관한 법률",
}
# Words and endings that join the words of a law's name, words before a name, endings of other parts of a sentence.
LINKS = ("관한", "대한", "위한", "따른", "의한", "관하는", "및", "등", "또는", "하는", "당사자로")
JOINING = "의에과와"
NOISE = ("또한", "그리고", "및", "한편", "따라서", "이에", "아울러", "특히", "나아가", "위", "본", "동", "구", "현행", "당시", "관련", "해당", "각", "위반한", "위반하여", "이상")
TAILS = "는은이가을를로서도만며고다면게해여니나요까야든데지써바"
# Marks of case numbers and the courts that use them.
CODES = {
    "SUPREME": "다 도 두 후 므 그 마 모 무 재다 전합",
    "LOWER": "가합 가단 가소 나 라 고합 고단 고정 노 로 구합 구단 누 루 드합 드단 르 허 카합 카단 타경 하합 하단 회합 회단",
    "CONSTITUTIONAL": "헌가 헌나 헌다 헌라 헌마 헌바 헌사 헌아",
}
COURTS = {"대법원": "SUPREME", "헌법재판소": "CONSTITUTIONAL"}
# Number words, their units, and the letters of syllables in order.
NUMBERS = {"영": 0, "공": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "륙": 6, "칠": 7, "팔": 8, "구": 9}
SMALL = {"십": 10, "백": 100, "천": 1000}
LARGE = {"만": 10**4, "억": 10**8, "조": 10**12}
INITIAL = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIAL = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINAL = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"

CASE_NUMBER = r"([0-9]{4}|[0-9]{2})([가-힣]{1,3})([0-9]{1,7})"
TAG_BASE = 0xE0000


def lookup(key: Column, table: dict) -> Column:
    """Value of a small constant table, null for other keys."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def article(text: Column) -> Column:
    """390의2 for 제390조의2, 390-2 and 390의2; a text without a number loses only blanks and marks."""
    t = F.replace(F.regexp_replace(text, r"[\s제조]", ""), F.lit("-"), F.lit("의"))
    plain = lambda c: F.regexp_replace(c, "^0+([0-9])", "$1")
    base, sub = (F.regexp_extract(t, "([0-9]+)(?:의([0-9]+))?", i) for i in (1, 2))
    return F.when(base == "", t).when(sub == "", plain(base)).otherwise(F.concat(plain(base), F.lit("의"), plain(sub)))


def law_name(text: Column) -> Column:
    """The name of the law that a text ends in: bracketed, or the longest run of words at the end that can be of one name.

    A word belongs to the run by itself and its neighbours alone. Short names are spelled out; names of ten letters or
    fewer lose their blanks.
    """
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    inside = squeeze(F.regexp_extract(text, r"[「『]([^」』]+)[」』]?\s*$", 1))
    words = F.split(squeeze(F.regexp_replace(text, "[「」『』]", " ")), " ")
    joint = lambda w: w.isin(*LINKS) | w.rlike(f"[{JOINING}]$")
    noun = lambda w: w.rlike("^[가-힣A-Za-z·]{2,}$") & ~w.rlike(f"[{TAILS}]$") & ~w.rlike("[가-힣]{2,}한$|[가-힣](된|던)$") & ~w.isin(*NOISE)

    def foreign(w, i):
        before, after = F.get(words, i - 1), F.get(words, i + 1)
        party = ((w == "당사자로") & (after == "하는")) | (w.rlike("[을를]$") & (after == "당사자로"))
        listed = w.isin("및", "또는") & noun(before) & ~before.rlike("(법|법률|령|규칙|조례)$")
        part = (i == F.size(words) - 1) | party | listed | (joint(w) & ~w.isin(*NOISE)) | noun(w)
        return F.when(~F.coalesce(part, F.lit(False)), i)

    start = F.coalesce(F.array_max(F.transform(words, foreign)), F.lit(-1)) + 2
    kept = F.slice(words, start, F.size(words))
    opens = lambda w, i: (i == F.size(kept) - 1) | ~joint(w) | F.exists(F.slice(kept, i + 2, F.size(kept)), lambda x: x.isin(*LINKS))
    name = F.array_join(F.slice(kept, F.greatest(F.array_position(F.transform(kept, opens), True).cast("int"), F.lit(1)), F.size(kept)), " ")
    name = F.when(inside != "", inside).otherwise(F.regexp_replace(name, "^(또한|그리고|한편|따라서|아울러|특히|나아가)(?=.{2})", ""))
    compact = F.replace(name, F.lit(" "), F.lit(""))
    return F.coalesce(lookup(compact, ALIASES), F.when(F.length(compact) <= 10, compact).otherwise(name))


def court_family(court: Column) -> Column:
    """SUPREME, CONSTITUTIONAL or LOWER by the name of a court; null for other names."""
    return F.coalesce(lookup(court, COURTS), F.when(court.rlike("법원$"), "LOWER"))


def code_family(code: Column) -> Column:
    """The courts that use a mark of case numbers; null for an unknown mark."""
    return lookup(code, {c: f for f, cs in CODES.items() for c in cs.split()})


def case_parts(text: Column) -> tuple[Column, Column, Column]:
    """Filing year with four digits, mark and serial of the first case number; nulls without one."""
    t = F.regexp_replace(text, r"\s", "")
    y, code, serial = (F.nullif(F.regexp_extract(t, CASE_NUMBER, i), F.lit("")) for i in (1, 2, 3))
    return F.when(F.length(y) == 4, y.cast("int")).otherwise(y.cast("int") + 1900), code, serial.cast("int")


def case_possible(text: Column, this_year: int) -> Column:
    """Whether a case number has a known mark and a year that has come; null without a case number."""
    year, code, _ = case_parts(text)
    return F.when(code.isNotNull(), code_family(code).isNotNull() & (year <= this_year) & (year >= 1900))


def amount_words(text: Column) -> Column:
    """The number that words such as 이억오천만 or 3억 5천만 spell; null if any other letter stands in them or no word does."""
    t = F.regexp_replace(F.regexp_replace(text, r"[\s,]", ""), "^(일금|금)|[원정]+$", "")
    pieces = F.regexp_extract_all(t, F.lit("[0-9]+|[^0-9]"), F.lit(0))
    long = lambda v: F.lit(v).cast("long")
    state = lambda total, part, digit, ok: F.struct(total.alias("total"), part.alias("part"), digit.alias("digit"), ok.alias("ok"))

    def step(s, x):
        digit = F.coalesce(lookup(x, NUMBERS).cast("long"), x.try_cast("long"))
        small, large = lookup(x, SMALL).cast("long"), lookup(x, LARGE).cast("long")
        head = s["part"] + F.coalesce(s["digit"], long(0))
        none = F.lit(None).cast("long")
        return (
            F.when(digit.isNotNull(), state(s["total"], s["part"], digit, s["ok"] & s["digit"].isNull()))
            .when(small.isNotNull(), state(s["total"], s["part"] + F.coalesce(s["digit"], long(1)) * small, none, s["ok"]))
            .when(large.isNotNull(), state(s["total"] + F.when((s["part"] == 0) & s["digit"].isNull(), long(1)).otherwise(head) * large, long(0), none, s["ok"]))
            .otherwise(state(s["total"], s["part"], s["digit"], F.lit(False)))
        )

    read = F.aggregate(pieces, state(long(0), long(0), F.lit(None).cast("long"), F.lit(True)), step, lambda s: F.when(s["ok"], s["total"] + s["part"] + F.coalesce(s["digit"], long(0))))
    return F.when(t.rlike(f"[{''.join(NUMBERS)}{''.join(SMALL)}{''.join(LARGE)}]"), read)


def hidden_tags(text: Column) -> Column:
    """The ASCII text that characters of the tag block hide; empty without any."""
    found = F.regexp_extract_all(text, F.lit(r"[\x{E0000}-\x{E007F}]"), F.lit(0))
    return F.array_join(F.transform(found, lambda c: F.chr(F.ascii(c) - TAG_BASE)), "")


def compose_letters(text: Column) -> Column:
    """Text whose separate letters are joined to syllables; letters without a vowel stay as they are."""
    pattern = f"[{INITIAL}][{MEDIAL}](?:[{FINAL}](?![{MEDIAL}]))?|[^{INITIAL}]+|."
    at = lambda letters, c: F.instr(F.lit(letters), c)
    place = lambda s, i: F.substring(s, i, 1)

    def join(s):
        code = 0xAC00 + ((at(INITIAL, place(s, 1)) - 1) * 21 + at(MEDIAL, place(s, 2)) - 1) * 28 + F.when(F.length(s) > 2, at(FINAL, place(s, 3))).otherwise(0)
        return F.when(s.rlike(f"^[{INITIAL}][{MEDIAL}]"), F.decode(F.unhex(F.hex(code)), "UTF-16BE")).otherwise(s)

    return F.when(text.rlike(f"[{INITIAL}][{MEDIAL}]"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s){pattern}"), F.lit(0)), join), "")).otherwise(text)


def first_match(text: Column, rules: dict[str, str], otherwise: str | None = None) -> Column:
    """The name of the first rule whose pattern is in the text."""
    named = reduce(lambda acc, kv: acc.when(text.rlike(kv[1]), kv[0]), list(rules.items())[1:], F.when(text.rlike(next(iter(rules.values()))), next(iter(rules))))
    return named.otherwise(F.lit(otherwise))
