"""Column functions that read numbers, amounts, labels and case numbers from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.text import whole

# Units of Korean amounts, largest first.
UNITS = (("조", 10**12), ("억", 10**8), ("천만", 10**7), ("백만", 10**6), ("만", 10**4), ("천", 10**3))
MULTIPLIERS = {"k": 10**3, "m": 10**6, "b": 10**9}


def number(text: Column) -> Column:
    """A number with thousands commas, else null."""
    clean = F.regexp_replace(F.trim(text), ",", "")
    return F.when(clean.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), clean.try_cast("double"))


def korean_amount(text: Column) -> Column:
    """Whole won of an amount like 1억 2,500만 원: each unit at most once, in falling order; null without an amount."""
    t = F.regexp_replace(text, "[ ,]", "")
    p = "^(-?)" + "".join(f"(?:([0-9]+){u})?" for u, _ in UNITS) + "([0-9]+)?원$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, p, i), F.lit("")).cast("long"), F.lit(0))
    total = part(len(UNITS) + 2)
    for i, (_, m) in enumerate(UNITS):
        total = total + part(i + 2) * m
    return F.when(t.rlike(p) & (t != "원") & (t != "-원"), total * F.when(F.regexp_extract(t, p, 1) == "-", -1).otherwise(1))


def expression(text: Column) -> Column:
    """Value of integers joined by + and -, read from left to right; null if the text is anything else."""
    t = F.regexp_replace(text, " ", "")
    terms = F.transform(F.regexp_extract_all(t, F.lit("[+-]?[0-9]+"), F.lit(0)), lambda x: F.replace(x, F.lit("+"), F.lit("")).cast("long"))
    return F.when(t.rlike("^[+-]?[0-9]+([+-][0-9]+)*$"), F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x))


def case_number(text: Column) -> Column:
    """A case number without spaces, as year, code and serial; null if it has another form."""
    t = F.regexp_replace(text, " ", "")
    return F.when(t.rlike("^[0-9]{2,4}[가-힣A-Za-z]{1,3}[0-9]{1,7}$"), t)


def label_range(text: Column) -> Column:
    """Numbers of `No. 3 to 6` or `No. 4`; an empty array for other texts and reversed ranges."""
    a = F.regexp_extract(text, r"No\. ?([0-9]{1,6})", 1).try_cast("int")
    b = F.regexp_extract(text, r"No\. ?[0-9]{1,6} (?:to|내지) ([0-9]{1,6})", 1).try_cast("int")
    end = F.coalesce(b, a)
    return F.when(a.isNotNull() & (end >= a), F.sequence(a, F.when(end >= a, end).otherwise(a))).otherwise(F.array().cast("array<int>"))


def contrast(r1, g1, b1, r2, g2, b2) -> Column:
    """WCAG contrast ratio of two colours with channels from 0 to 255."""

    def channel(c):
        c = c / 255.0
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))

    lum = lambda r, g, b: 0.2126 * channel(r) + 0.7152 * channel(g) + 0.0722 * channel(b)
    x, y = lum(r1, g1, b1), lum(r2, g2, b2)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def polarity(text: Column) -> Column:
    """ASSERTED, NEGATED, REPORTED or HYPOTHETICAL, by the first rule that matches."""
    # The dotted capital I becomes one letter, as in SQL, not a letter and a mark.
    t = F.lower(F.translate(text, "\u0130", "i"))
    rules = (("if|would|might|may", "HYPOTHETICAL"), ("said|claims|alleged|according to", "REPORTED"), ("not|no|never|none", "NEGATED"))
    return F.coalesce(*(F.when(t.rlike(whole(p)), name) for p, name in rules), F.lit("ASSERTED"))
