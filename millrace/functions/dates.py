"""Lenient dates as TIMESTAMP_NTZ columns. What can't be a date is NULL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month abbreviations in order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """f(value) with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), f), 1)


def month_number(x) -> Column:
    """1 to 12 by a month's first three letters; -1 if unknown."""
    key = F.lower(F.substring(F.trim(_c(x)), 1, 3))
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), key).cast("int")
    return F.when(at > 0, at).otherwise(-1)


def _date_first(x) -> Column:
    """x without a weekday before it, with a clock before the date or between the date and its year moved to the end, and with colons in a clock of digits only."""
    s = F.regexp_replace(F.trim(_c(x)), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+|(?<=\d)T(?=\d)", " ")
    s = F.regexp_replace(F.ltrim(s), r"^(\d{1,2}:\d{2}(?::\d{2})?)\s+(.*\d{4}.*)$", "$2 $1")
    s = F.regexp_replace(s, r"^(\S+(?:\s+\d{1,2})?)\s+(\d{1,2}:\d{2}(?::\d{2})?)\s+(\d{4})\b", "$1 $3 $2")
    return F.regexp_replace(s, r"^(\d{8})\s+(\d{2})(\d{2})(\d{2})?(?!\d)", "$1 $2:$3:$4")


def classify(x) -> Column:
    """ISO8601, YMD, MDY (also where only the order of day and month is open), DMY, MonthDayYear, DayMonthYear, MDYWithTime (a clock before the year) or Unknown."""
    raw, s = F.trim(_c(x)), _date_first(x)
    numbers = r"^(\d{1,2})[-/.](\d{1,2})(?:[-/.]|\s+(?=\d{4}))(\d{4}|\d{2})(?!\d)"
    a, b = (F.nullif(F.regexp_extract(s, numbers, k), F.lit("")).cast("int") for k in (1, 2))
    possible = (a > 0) & (b > 0) & (a <= 31) & (b <= 31) & ((a <= 12) | (b <= 12))
    return (
        F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}T") & ~raw.rlike(r"[+-]\d{2}:?\d{2}$"), "ISO8601")
        .when(s.rlike(r"^\d{4}([-/.]\d{1,2}[-/.]\d{1,2}|(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01]))(?!\d)"), "YMD")
        .when(raw.rlike(r"(?i)^(\d{1,2}/\d{1,2}|[a-z]+,?\s+[a-z]+\s+\d{1,2})\s+\d{1,2}:\d{2}(:\d{2})?\s+\d{4}"), "MDYWithTime")
        .when(possible, F.when(a > 12, "DMY").otherwise("MDY"))
        .when(s.rlike(r"(?i)^[a-z]{3,9}\.?\s*\d{1,2}(st|nd|rd|th)?[\s,-]+(\d{4}|\d{2})(?!\d)"), "MonthDayYear")
        .when(s.rlike(r"(?i)^\d{1,2}(st|nd|rd|th)?[\s-]+[a-z]{3,9}\.?[\s,-]+\d{2,4}"), "DayMonthYear")
        .otherwise("Unknown")
    )


#: One pattern of all forms: year first (groups 1 to 3), numbers (4 to 6), month name first (7 to 9), day first (10 to 12), a clock anywhere after (13 to 16).
_FORMS = (
    r"(?is)^(?:(\d{4})[-/.]?(\d{1,2})[-/.]?(\d{1,2})(?!\d)|(\d{1,2})[-/.](\d{1,2})(?:[-/.]|\s+(?=\d{4}))(\d{4}|\d{2})(?!\d)"
    r"|([a-z]{3,9})\.?\s*(\d{1,2})(?:st|nd|rd|th)?[\s,-]+(\d{4}|\d{2})(?![\d:])|(\d{1,2})(?:st|nd|rd|th)?[\s-]+([a-z]{3,9})\.?[\s,-]+(\d{4}|\d{2})(?![\d:]))"
    r"(?:.*?(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?:?\s*(?:([ap])\.?m\.?)?)?.*$"
)


def parse(x, day_first: bool = False, enforce: bool = False) -> Column:
    """A timestamp from year-first, numeric day/month/year and named-month forms, with an optional time.

    Years of two digits: 0 to 30 are 20xx, others 19xx. Impossible fields give NULL; unless
    enforced, an order of day and month that is impossible is turned round. A zone is not
    looked at. One pattern is matched once a value, and its groups are bound once.
    """
    found = F.split(F.regexp_replace(_date_first(x), _FORMS, "|" + "|".join(f"${k}" for k in range(1, 17)) + "|."), r"\|")

    def build(p: Column) -> Column:
        number = lambda k: F.when(p[k] != "", p[k].cast("int"))  # groups are digits or empty
        hour = F.coalesce(number(13), F.lit(0))
        half = F.lower(p[16])
        hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
        second = F.when(p[15] != "", p[15].cast("decimal(16,6)")).otherwise(F.lit(0).cast("decimal(16,6)"))
        month_first = F.lit(not day_first) if enforce else number(5) > 12 if day_first else ~(number(4) > 12)
        year = F.coalesce(number(1), number(6), number(9), number(12))
        year = F.when(year <= 30, year + 2000).when(year < 100, year + 1900).otherwise(year)
        month = F.when(p[1] != "", number(2)).when(p[4] != "", F.when(month_first, number(4)).otherwise(number(5))).otherwise(month_number(F.concat(p[7], p[11])))
        day = F.when(p[1] != "", number(3)).when(p[4] != "", F.when(month_first, number(5)).otherwise(number(4))).otherwise(F.concat(p[8], p[10]).cast("int"))
        return F.when(F.size(p) == 18, F.try_make_timestamp_ntz(year, month, day, hour, F.coalesce(number(14), F.lit(0)), second))

    return let(found, build)


def infer_order(df: DataFrame, column: str) -> DataFrame:
    """One row, `date_order`: MonthFirst, DayFirst, None for evidence of both, Auto for none."""
    pattern = r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.]\d{2,4}"
    a, b = (F.nullif(F.regexp_extract(column, pattern, k), F.lit("")).cast("int") for k in (1, 2))
    votes = df.agg(F.coalesce(F.max((b > 12) & (a <= 12)), F.lit(False)).alias("m"), F.coalesce(F.max((a > 12) & (b <= 12)), F.lit(False)).alias("d"))
    return votes.select(F.when(F.col("m") & F.col("d"), "None").when(F.col("m"), "MonthFirst").when(F.col("d"), "DayFirst").otherwise("Auto").alias("date_order"))


def days_between(a, b) -> Column:
    """Whole 24-hour days from a to b, truncated toward zero."""
    return F.timestamp_diff("DAY", _c(a), _c(b))


def seconds_between(a, b) -> Column:
    return F.timestamp_diff("SECOND", _c(a), _c(b))


def hours_between(a, b) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(a), _c(b)) / F.lit(3.6e9)


def plus_months(x, n: int) -> Column:
    """Clamped to the month's end."""
    return F.timestamp_add("MONTH", F.lit(n), _c(x))


def end_of_month(x) -> Column:
    return F.last_day(_c(x).cast("date"))


def day_of_week(x) -> Column:
    """Monday is 1."""
    return F.weekday(_c(x)) + 1


def next_day_of_week(x, name: str) -> Column:
    """The first such day strictly after x."""
    return F.next_day(_c(x).cast("date"), name)


def days_in_month(x) -> Column:
    return F.dayofmonth(end_of_month(x))


def epoch_millis(x) -> Column:
    """Milliseconds since 1970 as a timestamp without zone, in UTC."""
    return F.timestamp_add("MICROSECOND", _c(x).cast("long") * 1000, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def day_number(x) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(_c(x).cast("date"))


#: Units of shifts, as Spark's timestampadd() names them.
UNITS = ["MICROSECOND", "MILLISECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR"]


def plus(x, n: int | Column, unit: str) -> Column:
    """x moved by n units; months and years are clamped to the month's end. NULL stays NULL."""
    if unit.upper() not in UNITS:
        raise ValueError(f"no such unit: {unit}")
    return F.timestamp_add(unit.upper(), n if isinstance(n, Column) else F.lit(n), _c(x))


def of(year, month, day, hour=0, minute=0, second=0) -> Column:
    """A timestamp of fields (columns or numbers); impossible fields give NULL."""
    one = lambda v: v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(v)
    return F.try_make_timestamp_ntz(one(year), one(month), one(day), one(hour), one(minute), one(second).cast("decimal(16,6)"))


def of_epoch_day(x) -> Column:
    return F.date_from_unix_date(_c(x).cast("int")).cast("timestamp_ntz")


def with_field(x, **fields) -> Column:
    """x with year, month, day, hour, minute or second set; impossible dates give NULL."""
    x = _c(x)
    now = {"year": F.year(x), "month": F.month(x), "day": F.dayofmonth(x), "hour": F.hour(x), "minute": F.minute(x), "second": F.extract(F.lit("SECOND"), x)}
    unknown = set(fields) - set(now)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    return of(**{**now, **{k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()}})


def at_start_of_day(x) -> Column:
    return _c(x).cast("date").cast("timestamp_ntz")


def formatted(x, pattern: str) -> Column:
    """Text by a pattern of letters yMdHhmsSaE, with literal text in quotes; English names. Other letters (as the week year Y) are refused."""
    if set(re.sub(r"'[^']*'|[^A-Za-z]", "", pattern)) - set("yMdHhmsSaE"):
        raise ValueError(f"unknown letters in {pattern}")
    return F.date_format(_c(x), pattern)


def ymd(x) -> Column:
    return formatted(x, "yyyy-MM-dd")


def ymdhms(x) -> Column:
    return formatted(x, "yyyy-MM-dd HH:mm:ss")


def strict(x) -> Column:
    """A timestamp from yyyyMMdd or yyyy?MM?dd, with ?HH?mm?ss after it, ? being one character that is no digit; other shapes are an error."""
    s = _c(x)
    good = s.rlike(r"^\d{4}\D?\d{2}\D?\d{2}(\D\d{2}\D\d{2}(\D\d{2})?)?$")
    d = F.rpad(F.regexp_replace(s, r"\D", ""), 14, "0")
    at = lambda a, n: F.substring(d, a, n).cast("int")
    return F.when(s.isNull(), None).when(good, F.make_timestamp_ntz(at(1, 4), at(5, 2), at(7, 2), at(9, 2), at(11, 2), at(13, 2))).otherwise(F.raise_error(F.concat(F.lit("no date: "), s)).cast("timestamp_ntz"))


def duration(a, b) -> Column:
    """(days, hours, minutes, seconds) from a to b; the sign is on the largest unit that is not 0."""
    total = F.floor(F.timestamp_diff("MICROSECOND", _c(a), _c(b)) / F.lit(1e6))

    def parts(t: Column) -> Column:
        size = F.abs(t)
        units = [F.floor(size / 86400), F.floor(size / 3600) % 24, F.floor(size / 60) % 60, size % 60]
        signed, larger = [], F.lit(True)
        for u in units:
            signed.append(F.when(larger & (t < 0), -u).otherwise(u))
            larger = larger & (u == 0)
        return F.struct(*[v.cast("long").alias(n) for v, n in zip(signed, ("days", "hours", "minutes", "seconds"))])

    return let(total, parts)


def minutes_between(a, b) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(a), _c(b)) / F.lit(6e7)


def days_rounded(a, b) -> Column:
    """Days from a to b with their fraction, from whole seconds."""
    return F.timestamp_diff("SECOND", _c(a), _c(b)) / F.lit(86400.0)


def day_name(x, short: bool = False) -> Column:
    return F.date_format(_c(x), "EEE" if short else "EEEE")
