"""Uniqueness over several fields, in a scope, with or without case, on typed columns and on VARIANT records."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.language import Unique
from millrace.plans.projection import value_at


def _path(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """A dotted path through structs, maps and VARIANTs and its type; a path that cannot exist is an error."""
    first, _, rest = path.partition(".")
    kind = next((f.dataType for f in df.schema.fields if f.name == first), None)
    if kind is None:
        raise ValueError(f"no column {first}")
    column = value_at(F.col(f"`{first}`"), kind, rest) if rest else F.col(f"`{first}`")
    found = df.select(column.alias("x")).schema[0].dataType
    if isinstance(found, T.NullType):
        raise ValueError(f"no field {path}")
    return column, found


def _scalar(value: Column, kind: T.DataType, ignore_case: bool) -> Column:
    """A value as a key: a VARIANT's class and value as text, null for objects, lists and null; texts in one case if asked."""
    folded = lambda c: F.lower(c) if ignore_case else c
    if isinstance(kind, T.VariantType):
        named = F.schema_of_variant(value)
        as_text = F.when(named == "STRING", F.concat(F.lit("s:"), folded(F.try_variant_get(value, "$", "string"))))
        as_text = as_text.when(named == "BOOLEAN", F.concat(F.lit("b:"), F.try_variant_get(value, "$", "string")))
        return as_text.when(named.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.concat(F.lit("n:"), F.try_variant_get(value, "$", "double").cast("string")))
    return folded(value) if isinstance(kind, T.StringType) else value


def _items(value: Column, kind: T.DataType, ignore_case: bool) -> Column:
    """All values of a field, as an array of keys: the items of a list, or the one value."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _scalar(x, kind.elementType, ignore_case))
    one = F.array(_scalar(value, kind, ignore_case))
    if isinstance(kind, T.VariantType):
        listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: _scalar(x, kind, ignore_case))
        return F.when(F.schema_of_variant(value).startswith("ARRAY"), listed).otherwise(one)
    return one


def violations(df: DataFrame, rule: Unique) -> DataFrame:
    """(keys…, copies): the groups of rows that break the rule. A null field, or a list, exempts a row, a null scope is a scope."""
    keys = [_scalar(*_path(df, p), rule.ignore_case) for p in (*rule.fields, *rule.scope)]
    checked = df.where(reduce(and_, (c.isNotNull() for c in keys[: len(rule.fields)])))
    names = [p.replace(".", "_") for p in (*rule.fields, *rule.scope)]
    return checked.groupBy(*[c.alias(n) for c, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def conflicts(new: DataFrame, existing: DataFrame, rule: Unique, key: str) -> DataFrame:
    """The rows of ``new`` that another row of ``existing`` (by ``key``) already stands for.

    A list meets any equal item of a list, or an equal single value. Lists are exploded on
    both sides, so that every comparison is an equality that a join can hash.
    """

    def keyed(df: DataFrame, row: Column) -> DataFrame:
        own = [_path(df, p) for p in rule.fields]
        out = df.select(row.alias("row"), *[_items(*f, rule.ignore_case).alias(f"f{i}") for i, f in enumerate(own)], *[_scalar(*_path(df, p), rule.ignore_case).alias(f"s{i}") for i, p in enumerate(rule.scope)])
        for i in range(len(own)):
            out = out.withColumn(f"f{i}", F.explode(f"f{i}")).where(F.col(f"f{i}").isNotNull())
        return out.distinct()

    mine, held = keyed(new, F.col(key)).alias("n"), keyed(existing, F.col(key)).alias("e")
    tests = [F.col(f"n.f{i}") == F.col(f"e.f{i}") for i in range(len(rule.fields))] + [F.col(f"n.s{i}").eqNullSafe(F.col(f"e.s{i}")) for i in range(len(rule.scope))]
    hit = mine.join(held, reduce(and_, tests) & ~F.col("n.row").eqNullSafe(F.col("e.row")), "left_semi").select(F.col("row").alias("__row")).distinct()
    return new.join(hit, F.col(key).eqNullSafe(F.col("__row")), "left_semi")
