"""Calendar expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweir.functions.missing import col


def day_of_year(d: str | Column) -> Column:
    return F.dayofyear(col(d))


def iso_week(d: str | Column) -> Column:
    """ISO week number without its year: 30 December may be week 1."""
    return F.weekofyear(col(d))


def iso_year(d: str | Column) -> Column:
    """Year the ISO week belongs to (that of its Thursday)."""
    return F.year(F.date_add(week_start(d), 3))


def block_week(d: str | Column) -> Column:
    """Seven-day blocks counted from 1 January, whatever its weekday."""
    return F.floor((F.dayofyear(col(d)) - 1) / 7).cast("int") + 1


def weekday_number(d: str | Column) -> Column:
    """Sunday is 1, Saturday is 7."""
    return F.dayofweek(col(d))


def week_start(d: str | Column) -> Column:
    """Monday of the week."""
    return F.trunc(col(d), "week")


def week_label(d: str | Column) -> Column:
    """Monday of the week as e.g. ``May-06``."""
    return F.date_format(F.trunc(col(d), "week"), "MMM-dd")


def week_day_code(d: str | Column) -> Column:
    """``week.yearday`` read as a number; lossy (day 14 and day 140 agree), kept for display."""
    return F.concat_ws(".", iso_week(d).cast("string"), day_of_year(d).cast("string")).cast("double")


def overlay_date(d: str | Column, year: int = 2024) -> Column:
    """Same day of year projected on one leap year, to overlay seasons on one axis."""
    first = F.make_date(F.lit(year), F.lit(1), F.lit(1))
    return F.date_add(first, F.dayofyear(col(d)) - 1)


def parse_date(x: str | Column, formats: Sequence[str] = ("yyyy-MM-dd", "MM/dd/yyyy")) -> Column:
    """First format that fits, row by row; NULL when none does."""
    return F.coalesce(*[F.try_to_date(col(x), fmt) for fmt in formats])


def with_time_of_day(d: str | Column, clock: str | Column) -> Column:
    """Timestamp from a date and the time part of another timestamp (its date part is ignored)."""
    clock = col(clock)
    return F.make_timestamp_ntz(
        F.year(col(d)), F.month(col(d)), F.day(col(d)), F.hour(clock), F.minute(clock), F.second(clock)
    )


def _clock_seconds(t: str | Column) -> Column:
    """Seconds on the wall clock since 1970, whatever the session time zone (no daylight-saving jumps)."""
    t = col(t)
    of_day = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return F.unix_date(t.cast("date")).cast("bigint") * 86400 + of_day


def minutes_between(start: str | Column, end: str | Column) -> Column:
    return (_clock_seconds(end) - _clock_seconds(start)) / F.lit(60.0)


def hours_between(start: str | Column, end: str | Column) -> Column:
    return (_clock_seconds(end) - _clock_seconds(start)) / F.lit(3600.0)


def season_part(d: str | Column, cut: int) -> Column:
    """``pre`` up to and including the cut day of year, ``post`` after it."""
    day = F.dayofyear(col(d))
    return F.when(day <= cut, "pre").when(day > cut, "post")


def in_windows(d: str | Column, windows: Sequence[tuple[str, str]]) -> Column:
    """TRUE when the date lies in one of the inclusive ranges."""
    hit = F.lit(False)
    for first, last in windows:
        hit = hit | col(d).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return F.coalesce(hit, F.lit(False))
