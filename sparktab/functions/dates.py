"""Calendar handling as column expressions: detection, Jalali conversion, parts and differences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Date patterns accepted by the tolerant parser, each with the shape of the texts it can read.
PATTERNS = {
    "yyyy-MM-dd": r"[+-]?\d{4,}-\d\d-\d\d",
    "yyyy/MM/dd": r"[+-]?\d{4,}/\d\d/\d\d",
    "yyyy-M-d": r"[+-]?\d{4,}-\d\d?-\d\d?",
    "yyyy/M/d": r"[+-]?\d{4,}/\d\d?/\d\d?",
    "yyyy-MM-dd HH:mm:ss": r"[+-]?\d{4,}-\d\d-\d\d \d\d:\d\d:\d\d",
    "yyyy/MM/dd HH:mm:ss": r"[+-]?\d{4,}/\d\d/\d\d \d\d:\d\d:\d\d",
    "yyyy-MM-dd'T'HH:mm:ss": r"[+-]?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d",
    "MM/dd/yyyy": r"\d\d/\d\d/[+-]?\d{4,}",
    "M/d/yyyy": r"\d\d?/\d\d?/[+-]?\d{4,}",
    "yyyyMMdd": r"\d{8}",
}
# Year bands that tell the calendars apart.
JALALI_YEARS = (1200, 1500)
GREGORIAN_YEARS = (1800, 2200)

PARTS = ("year", "month", "day", "day_of_week", "hour", "day_of_year", "is_weekend")


def date_parts_text(col: Column) -> Column:
    """The text split on ``/`` when it has one, else on ``-``."""
    s = F.trim(col)
    return F.when(s.contains("/"), F.split(s, "/")).when(s.contains("-"), F.split(s, "-"))


def is_pure_date_string(col: Column) -> Column:
    """Three whole numbers joined by ``/`` or ``-`` and no letter."""
    s = F.trim(col)
    whole = r"\s*[+-]?\d+(_\d+)*\s*"
    shape = F.when(s.contains("/"), s.rlike(f"^{whole}/{whole}/{whole}$")).when(
        s.contains("-"), s.rlike(r"^\s*\+?\d+\s*-\s*\+?\d+\s*-\s*\+?\d+\s*$")
    )
    return F.coalesce(shape & ~s.rlike(r"\p{L}"), F.lit(False))


def calendar_type(col: Column) -> Column:
    """``jalali``, ``gregorian`` or ``unknown`` from the first of three parts."""
    parts = date_parts_text(col)
    year = F.when(F.size(parts) == 3, F.trim(F.get(parts, F.lit(0))).try_cast("int"))
    return (
        F.when(year.between(*JALALI_YEARS), "jalali")
        .when(year.between(*GREGORIAN_YEARS), "gregorian")
        .otherwise("unknown")
    )


def parse_gregorian(col: Column) -> Column:
    """Timestamp from the first pattern that fits, else missing.

    A failing parse is an exception, so a text meets a parser only if it has its shape.
    """
    s = F.trim(col)
    parsed = F.coalesce(*[F.when(s.rlike(f"^{shape}$"), F.try_to_timestamp(s, F.lit(p))) for p, shape in PATTERNS.items()])
    return F.when(s.rlike(r"^[+-]?\d[\d/:T -]*[\d]$"), parsed)


def jalali_is_leap(year: Column) -> Column:
    """33-year rule."""
    return F.pmod(year, F.lit(33)).isin(1, 5, 9, 13, 17, 22, 26, 30)


def jalali_to_date(year: Column, month: Column, day: Column) -> Column:
    """Gregorian date of a Jalali year, month and day; invalid combinations are missing.

    Leap years of a 33-year cycle that precede ``year`` are counted in closed
    form and the day number is added to the first day of year 1399.
    """

    def leaps_before(y):
        inside = F.pmod(y - 1, F.lit(33))
        counted = sum((inside >= k).cast("int") for k in (1, 5, 9, 13, 17, 22, 26, 30))
        return F.floor((y - 1) / 33) * 8 + counted

    month_start = F.when(month <= 7, (month - 1) * 31).otherwise(186 + (month - 7) * 30)
    month_days = (
        F.when(month <= 6, 31).when(month <= 11, 30).when(jalali_is_leap(year), 30).otherwise(29)
    )
    anchor = F.lit(1399)
    offset = (year - anchor) * 365 + leaps_before(year) - leaps_before(anchor) + month_start + day - 1
    valid = (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= month_days)
    return F.when(valid, F.date_add(F.to_date(F.lit("2020-03-20")), offset.cast("int")))


def parse_jalali(col: Column) -> Column:
    """Timestamp of a ``year/month/day`` Jalali text."""
    parts = F.split(F.trim(col), "/")
    number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("int")
    return F.when(F.size(parts) == 3, jalali_to_date(number(0), number(1), number(2))).cast("timestamp")


def calendar_parts(ts: Column, prefix: str) -> list[Column]:
    """Seven doubles; Monday is day 0 and a missing date is not a weekend."""
    dow = F.weekday(ts)
    values = (
        F.year(ts), F.month(ts), F.dayofmonth(ts), dow, F.hour(ts), F.dayofyear(ts),
        F.coalesce(dow >= 5, F.lit(False)),
    )
    return [v.cast("double").alias(f"{prefix}_{part}") for v, part in zip(values, PARTS)]


def days_between(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)
