"""Text: trimming, blanks, calendar escapes, templates, query strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = "".join(map(chr, range(1, 33)))


def trimmed(c: Column) -> Column:
    """Without spaces and control characters at both ends."""
    return F.btrim(c, F.lit(_LOW))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"\S")


def or_default(c: Column, default: str) -> Column:
    return F.when(is_blank(c), F.lit(default)).otherwise(c)


def or_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def calendar_escaped(c: Column) -> Column:
    """Backslash, semicolon, comma and line feed escaped in this order, carriage returns dropped; null is empty."""
    steps = [("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n"), ("\r", "")]
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), steps, F.coalesce(c, F.lit("")))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with each ``${name}`` replaced."""
    return reduce(lambda x, kv: F.replace(x, F.lit("${" + kv[0] + "}"), F.coalesce(kv[1], F.lit(""))), values.items(), template)


def query_parameter(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def one_of(c: Column, values: list[str], default: str) -> Column:
    """Upper-cased if it is among ``values``, else ``default``."""
    return F.when(F.upper(c).isin(values), F.upper(c)).otherwise(F.lit(default))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def json_like(value: Column, query: str) -> Column:
    """Whether a value's JSON text, keys included, is like ``query``; % and _ keep their meaning."""
    return F.to_json(value).ilike(f"%{query}%")


def role_name(claims: Column) -> Column:
    """The name of the role in a JSON object of claims; null where there is none or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(claims), "$.role.name", "string")


def claim_authorities(claims: Column) -> Column:
    """The authorities that a JSON object of claims lists, empty where it lists none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(claims), "$.authorities", "array<string>"), F.array().cast("array<string>"))
