"""Times: calendar ranges, times of day, stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_of(kind: str | None, day: Column) -> tuple[Column, Column]:
    """First and last day of the day, ISO week, month or year that ``day`` lies in; an unknown kind is a day."""
    kind = (kind or "day").lower()
    if kind == "week":
        monday = F.trunc(day, "week")
        return monday, F.date_add(monday, 6)
    if kind == "month":
        return F.trunc(day, "month"), F.last_day(day)
    if kind == "year":
        first = F.trunc(day, "year")
        return first, F.make_date(F.year(day), F.lit(12), F.lit(31))
    return day, day


def time_of_day(hhmm: Column, default: str) -> Column:
    """HH:mm:ss of a time like 09:30; null and malformed values are ``default``."""
    good = F.when(hhmm.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]\z"), hhmm)
    return F.concat(F.coalesce(good, F.lit(default)), F.lit(":00"))


def calendar_stamp(day: Column, hhmm: Column, default: str) -> Column:
    """Like 20240131T093000."""
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("T"), F.replace(time_of_day(hhmm, default), F.lit(":"), F.lit("")))


def utc_text(stamp: Column) -> Column:
    """ISO 8601 with Z; fractions have three or six digits, and seconds are left out where they are zero."""
    text = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    for long, short in ((r"\.000000$", ""), (r"(\.\d{3})000$", "$1"), (r"(T\d\d:\d\d):00$", "$1")):
        text = F.regexp_replace(text, long, short)
    return F.concat(text, F.lit("Z"))
