"""Calendar events: ranges, tagged views, defaults and the iCalendar export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import calendar_escaped, is_blank, or_default, or_null
from millrace.functions.times import calendar_stamp, window_of

DEFAULT_START, DEFAULT_END, DEFAULT_COLOR = "09:00", "18:00", "#c8f5d8"


def events_in(events: DataFrame, user_id: int | None, kind: str | None, day: Column) -> DataFrame:
    """A user's events (event_date) of a day, week, month or year; the dates are constants, so the scan prunes by them."""
    first, last = window_of(kind, day)
    own = events if user_id is None else events.where(F.col("user_id") == user_id)
    return own.where(F.col("event_date").between(first, last))


def tagged(events: DataFrame, user_id: int, kind: str | None, day: Column, today: Column) -> DataFrame:
    """Three result sets in one, told apart by ``part``: events, today, tomorrow."""
    parts = [("events", events_in(events, user_id, kind, day)), ("today", events_in(events, user_id, "day", today)), ("tomorrow", events_in(events, user_id, "day", F.date_add(today, 1)))]
    out = None
    for name, df in parts:
        one = df.withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def with_defaults(requests: DataFrame, today: Column) -> DataFrame:
    """Requests with what they leave out filled in."""
    return requests.withColumns({
        "title": F.coalesce("title", F.lit("")),
        "event_date": F.coalesce("event_date", today),
        "start_time": or_default(F.col("start_time"), DEFAULT_START),
        "end_time": or_default(F.col("end_time"), DEFAULT_END),
        "color": or_default(F.col("color"), DEFAULT_COLOR),
        "description": F.coalesce("description", F.lit("")),
    })


def response(events: DataFrame) -> DataFrame:
    """As answered: ids and dates as text, a blank description as null."""
    return events.withColumns({"id": F.col("id").cast("string"), "event_date": F.col("event_date").cast("string"), "description": or_null(F.col("description"))})


def event_lines(events: DataFrame, user_id: int | None, today: Column, stamp: str, domain: str) -> DataFrame:
    """(event_date, start_time, id, lines): the lines of each event from ``today`` on."""
    own = events if user_id is None else events.where(F.col("user_id") == user_id)
    description = F.when(~is_blank(F.col("description")), F.concat(F.lit("DESCRIPTION:"), calendar_escaped(F.col("description"))))
    lines = F.array(
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), F.col("id").cast("string"), F.lit(f"@{domain}")),
        F.lit(f"DTSTAMP:{stamp}Z"),
        F.concat(F.lit("DTSTART:"), calendar_stamp(F.col("event_date"), F.col("start_time"), DEFAULT_START)),
        F.concat(F.lit("DTEND:"), calendar_stamp(F.col("event_date"), F.col("end_time"), DEFAULT_END)),
        F.concat(F.lit("SUMMARY:"), calendar_escaped(F.col("title"))),
        description,
        F.lit("END:VEVENT"),
    )
    return own.where(F.col("event_date") >= today).select("event_date", "start_time", "id", F.array_compact(lines).alias("lines"))


def header(product: str, name: str) -> list[str]:
    return ["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:{product}", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", f"X-WR-CALNAME:{name}", "X-WR-TIMEZONE:UTC"]


def calendar_text(events: DataFrame, user_id: int, today: Column, stamp: str, domain: str, product: str, name: str) -> DataFrame:
    """One user's calendar as one row ``ics``, lines ended by CR LF; its size is that of one user's events."""
    own = event_lines(events, user_id, today, stamp, domain)
    body = own.agg(F.array_sort(F.collect_list(F.struct("event_date", "start_time", "id", "lines"))).alias("e")).select(F.flatten(F.transform("e", lambda x: x["lines"])).alias("body"))
    whole = F.concat(F.array(*map(F.lit, header(product, name))), F.col("body"), F.array(F.lit("END:VCALENDAR")))
    return body.select(F.concat(F.array_join(whole, "\r\n"), F.lit("\r\n")).alias("ics"))
