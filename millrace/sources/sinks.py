"""Sinks: calendars as text, frames as JSON, bootstrap rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.state import ensured


def write_calendar(ics: DataFrame, path: str) -> None:
    """The one-row text of a calendar; its own line ends are kept."""
    ics.coalesce(1).write.option("lineSep", "\r\n").text(path)


def frame(kind: str, payload: Column) -> Column:
    """A frame {type, payload}; null fields are left out."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("payload")))


def seeded(state: DataFrame, *steps: tuple[DataFrame, list[str]]) -> DataFrame:
    """Bootstrap rows added in order, where their keys are not there yet; repeating it changes nothing."""
    for rows, keys in steps:
        state = ensured(state, rows, keys)
    return state
