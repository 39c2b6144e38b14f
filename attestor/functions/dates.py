"""Date and money arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(start: Column, end: Column, first: bool = True, last: bool = True) -> Column:
    """Days from start to end; null if reversed. first, last: whether the days themselves count."""
    d = F.datediff(end, start) - 1 + int(first) + int(last)
    return F.when(end >= start, F.greatest(d, F.lit(0)))


def months_elapsed(start: Column, end: Column) -> Column:
    """Whole months; a start day beyond the end month's length counts as that month's last day."""
    m = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    due = F.least(F.dayofmonth(start), F.dayofmonth(F.last_day(end)))
    return F.greatest(m - F.when(F.dayofmonth(end) < due, 1).otherwise(0), F.lit(0))


def add_period(start: Column, years: int = 0, months: int = 0, days: int = 0) -> Column:
    """Calendar addition; a day that the month lacks becomes its last."""
    return F.date_add(F.add_months(start, 12 * years + months), days)


def weekday_matches(day: Column, stated: Column) -> Column:
    """Whether a stated weekday (Monday 0) is that of the date; null if either is missing."""
    return F.weekday(day) == stated


def parse_date(text: Column) -> Column:
    """A date from YYYY-MM-DD, YYYY. MM. DD., YYYY/MM/DD or YYYY년 MM월 DD일 inside text; null if it is no date of the calendar."""
    p = r"([0-9]{4})\s*[-./년]\s*([0-9]{1,2})\s*[-./월]\s*([0-9]{1,2})"
    y, m, d = (F.regexp_extract(text, p, i) for i in (1, 2, 3))
    return F.when(text.rlike(p), F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date"))


def simple_interest(principal: Column, rate: Column, days: Column, basis: int = 365) -> Column:
    return principal * rate * days / basis


def round_mode(value: Column, mode: str, places: int = 0) -> Column:
    """FLOOR, CEIL, TRUNCATE, HALF_UP or HALF_EVEN on a decimal."""
    scale = F.lit(10**places)
    if mode == "HALF_UP":
        return F.round(value, places)
    if mode == "HALF_EVEN":
        return F.bround(value, places)
    if mode == "FLOOR":
        return F.floor(value * scale) / scale
    if mode == "CEIL":
        return F.ceil(value * scale) / scale
    return F.when(value < 0, F.ceil(value * scale)).otherwise(F.floor(value * scale)) / scale


def vested(total: Column, months: Column, cliff: int, period: int) -> Column:
    """Linear vesting by whole months with a cliff; all of it after the period."""
    return F.when(months < cliff, 0).when(months >= period, total).otherwise(F.floor(total * months / period))


def delay_penalty(amount: Column, rate: Column, days: Column, cap: float) -> Column:
    """Penalty per day of delay, at most `cap` of the amount; none for no delay."""
    return F.least(amount * rate * F.greatest(days, F.lit(0)), amount * cap)


def passes(votes: Column, of: Column, share: tuple[int, int], strict: bool) -> Column:
    """Whether votes are more than (strict) or at least a share of those entitled, in whole numbers; null if nobody is."""
    a, b = votes * share[1], of * share[0]
    return F.when(of > 0, (a > b) if strict else (a >= b))
