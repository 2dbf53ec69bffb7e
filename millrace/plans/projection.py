"""Projections: public fields, path extraction, nested construction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.language import Definition


def _in_variant(value: Column, parts: list[str], lists: int = 2) -> Column:
    """The value at a path of a VARIANT, through objects and lists (at most ``lists`` directly inside each other).

    Null items are dropped and an empty list is null.
    """
    if not parts:
        return value
    inner = _in_variant(F.try_variant_get(value, f"$['{parts[0]}']", "variant"), parts[1:])
    if not lists:
        return inner
    # null in JSON is no value
    each = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: _in_variant(x, parts, lists - 1)), lambda x: x.isNotNull() & ~F.coalesce(F.is_variant_null(x), F.lit(False)))
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.when(F.size(each) > 0, F.to_variant_object(each))).otherwise(inner)


def extract(column: Column, kind: T.DataType, parts: list[str]) -> tuple[Column, T.DataType] | None:
    """The value at a path, through structs, maps, VARIANTs and lists; null items are dropped and an empty list is null."""
    if not parts:
        return column, kind
    if isinstance(kind, T.StructType):
        match = next((f for f in kind.fields if f.name == parts[0]), None)
        return None if match is None else extract(column.getField(parts[0]), match.dataType, parts[1:])
    if isinstance(kind, T.MapType):
        return extract(column.getItem(parts[0]), kind.valueType, parts[1:])
    if isinstance(kind, T.VariantType):
        return _in_variant(column, parts), kind
    if isinstance(kind, T.ArrayType):
        inner = extract(F.lit(None), kind.elementType, parts) if not isinstance(kind.elementType, T.VariantType) else (None, kind.elementType)
        if inner is None:
            return None
        each = F.filter(F.transform(column, lambda x: extract(x, kind.elementType, parts)[0]), lambda x: x.isNotNull())
        return F.when(F.size(each) > 0, each), T.ArrayType(inner[1])
    return None


def value_at(column: Column, kind: T.DataType, path: str) -> Column:
    """The value at a path through structs, maps and objects of a VARIANT; a list on the way gives null."""
    parts = path.split(".")
    for i, part in enumerate(parts):
        if isinstance(kind, T.VariantType):
            return F.try_variant_get(column, "$" + "".join(f"['{p}']" for p in parts[i:]), "variant")
        if isinstance(kind, T.MapType):
            column, kind = column.getItem(part), kind.valueType
            continue
        match = next((f for f in kind.fields if f.name == part), None) if isinstance(kind, T.StructType) else None
        if match is None:
            return F.lit(None)
        column, kind = column.getField(part), match.dataType
    return column


def nested(values: Iterable[tuple[str, Column]]) -> Column:
    """A struct built from dotted paths; a later value replaces an earlier one."""
    tree: dict = {}
    for path, value in values:
        at = tree
        *outer, last = path.split(".")
        for part in outer:
            at = at.setdefault(part, {}) if isinstance(at.get(part, {}), dict) else at.update({part: {}}) or at[part]
        at[last] = value

    def build(node: dict) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return build(tree)


def public(df: DataFrame, definition: Definition, data: str = "data") -> DataFrame:
    """``df`` with ``data`` cut to its public fields; everything, where reading is not public at all. A VARIANT stays one."""
    if definition.public_get is not True:
        return df
    kind = df.schema[data].dataType
    found = [(f.path, got[0]) for f in definition.fields if f.public and f.key.strip() and (got := extract(F.col(data), kind, f.path.split(".")))]
    if isinstance(kind, T.VariantType):
        return df.withColumn(data, F.to_variant_object(nested(found)) if found else F.parse_json(F.lit("{}")))
    return df.withColumn(data, nested(found) if found else F.lit(None).cast("struct<>"))


def full(df: DataFrame) -> DataFrame:
    """A record as it is answered: without its definition and creator."""
    return df.drop("entity", "createdBy")


def merged(old: Column, new: Column) -> Column:
    """A shallow merge of two maps; the keys of ``new`` win, and none is ever removed."""
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>")))


def as_map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Rows as one map of a bounded result, such as one user's counts."""
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))


def public_items(items: Column, flag: str) -> Column:
    """The items of a list whose flag is true."""
    return F.filter(items, lambda x: F.coalesce(x[flag], F.lit(False)))
