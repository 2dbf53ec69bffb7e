"""From plans to columns and frames.

Typed columns give plain comparisons, which reach the Parquet scan. VARIANT fields are
read by class, as a value only compares with values of its own class. Missing and null
are the same: ``neq`` and ``nin`` keep them.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.language import Literal, Plan, Predicate, Range, literal, literals

_CLASS = {bool: "boolean", int: "number", float: "number", str: "string"}


def _classed(column: Column, path: str, kind: str) -> Column:
    """What a VARIANT holds at ``path`` if its class is ``kind``, else null."""
    named = F.schema_of_variant(F.try_variant_get(column, path, "variant"))
    if kind == "number":
        return F.when(named.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(column, path, "double"))
    return F.when(named == kind.upper(), F.try_variant_get(column, path, kind))


class Resolved:
    """A path of a frame: a typed column, an array, a field of a VARIANT, or nothing."""

    def __init__(self, df: DataFrame, path: str) -> None:
        self.column, self.kind, self.path = F.lit(None), None, None
        parts, schema, column = path.split("."), df.schema, None
        for i, part in enumerate(parts):
            match = next((f for f in schema.fields if f.name == part), None) if isinstance(schema, T.StructType) else None
            if match is None:
                break
            column = F.col(f"`{part}`") if column is None else column.getField(part)
            schema = match.dataType
            if isinstance(schema, T.VariantType):
                self.column, self.kind, self.path = column, schema, "$" + "".join(f"['{p}']" for p in parts[i + 1 :])
                return
            if isinstance(schema, T.MapType):
                rest = ".".join(parts[i + 1 :])
                self.column, self.kind = (column.getItem(rest), schema.valueType) if rest else (column, schema)
                return
            if i == len(parts) - 1:
                self.column, self.kind = column, schema

    @property
    def variant(self) -> bool:
        return isinstance(self.kind, T.VariantType)

    def missing(self) -> Column:
        if not self.variant:
            return self.column.isNull()
        at = F.try_variant_get(self.column, self.path, "variant") if self.path != "$" else self.column
        return at.isNull() | F.coalesce(F.is_variant_null(at), F.lit(False))

    def of(self, kind: str) -> Column:
        """The value where it is of the class ``kind`` (boolean, number, string), else null."""
        if self.variant:
            return _classed(self.column, self.path, kind)
        mine = {T.StringType: "string", T.BooleanType: "boolean"}.get(type(self.kind), "number" if isinstance(self.kind, T.NumericType) else None)
        return self.column if mine == kind else F.lit(None).cast({"string": "string", "boolean": "boolean", "number": "double"}[kind])

    def test(self, value: Literal, compare) -> Column:
        """``compare(column, literal)`` if the classes agree; any element of an array may answer."""
        if isinstance(self.kind, T.ArrayType):
            inner = "string" if isinstance(self.kind.elementType, T.StringType) else "number"
            if inner != _CLASS[type(value)]:
                return F.lit(False)
            return F.coalesce(F.exists(self.column, lambda x: F.coalesce(compare(x, F.lit(value)), F.lit(False))), F.lit(False))
        if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(value, str):
            # a deliberate extension: text that reads as a time compares with times
            return compare(self.column, F.try_to_timestamp(F.lit(value)).cast(self.kind))
        if self.variant:
            items = F.try_variant_get(self.column, self.path, "array<variant>")
            in_list = F.schema_of_variant(F.try_variant_get(self.column, self.path, "variant")).startswith("ARRAY")
            any_of = F.exists(items, lambda x: F.coalesce(compare(_classed(x, "$", _CLASS[type(value)]), F.lit(value)), F.lit(False)))
            return F.coalesce(F.when(in_list, any_of).otherwise(compare(self.of(_CLASS[type(value)]), F.lit(value))), F.lit(False))
        if self.kind is None or _CLASS[type(value)] not in self._classes():
            return F.lit(False)
        return compare(self.column, F.lit(value))

    def _classes(self) -> tuple[str, ...]:
        return {T.StringType: ("string",), T.BooleanType: ("boolean",)}.get(type(self.kind), ("number",) if isinstance(self.kind, T.NumericType) else ())

    def plain(self, values: list[Literal]) -> list[Literal] | None:
        """Those of ``values`` that a plain typed column can equal; None where the column is not of that kind."""
        return [v for v in values if _CLASS[type(v)] in self._classes()] if self._classes() else None

    def matches(self, pattern: str) -> Column:
        """Whether a text, or any text in a list, matches."""
        if isinstance(self.kind, T.ArrayType):
            if not isinstance(self.kind.elementType, T.StringType):
                return F.lit(False)
            return F.coalesce(F.exists(self.column, lambda x: x.rlike(pattern)), F.lit(False))
        one = F.coalesce(self.of("string").rlike(pattern), F.lit(False))
        if not self.variant:
            return one
        items = F.try_variant_get(self.column, self.path, "array<variant>")
        return one | F.coalesce(F.exists(items, lambda x: F.coalesce(_classed(x, "$", "string").rlike(pattern), F.lit(False))), F.lit(False))

    def sort_keys(self) -> list[Column]:
        """What orders by this path: a VARIANT by its class (number, text, object, list, boolean), then by value."""
        if not self.variant:
            return [self.column]
        named = F.schema_of_variant(F.try_variant_get(self.column, self.path, "variant"))
        classes = [("^(BIGINT|DOUBLE|FLOAT|DECIMAL)", 1), ("^STRING", 2), ("^OBJECT", 3), ("^ARRAY", 4), ("^BOOLEAN", 5), ("^VOID", None)]
        rank = F.lit(None).cast("int")
        for pattern, n in reversed(classes):
            rank = F.when(named.rlike(pattern), F.lit(n).cast("int")).otherwise(rank if pattern != "^VOID" else F.when(named.isNotNull(), 6))
        return [rank, self.of("number"), F.try_variant_get(self.column, self.path, "string")]


_COMPARE = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s]|_)", r"\\\1", text)


def _one(at: Resolved, p: Predicate) -> Column:
    if p.operator in _COMPARE:
        return at.test(literal(p.value), _COMPARE[p.operator])
    if p.operator == "neq":
        plain = at.plain([literal(p.value)])
        if plain:
            return ~at.column.eqNullSafe(F.lit(plain[0]))
        return ~F.coalesce(at.test(literal(p.value), _COMPARE["eq"]), F.lit(False))
    if p.operator in ("in", "nin"):
        values = literals(p.value)
        plain = at.plain(values)
        if plain is not None:
            if p.operator == "in":
                return at.column.isin(plain) if plain else F.lit(False)
            return at.column.isNull() | ~at.column.isin(plain) if plain else F.lit(True)
        any_of = reduce(or_, (F.coalesce(at.test(v, _COMPARE["eq"]), F.lit(False)) for v in values), F.lit(False))
        return any_of if p.operator == "in" else ~any_of
    if p.operator == "isnull":
        return at.missing()
    if p.operator == "isnotnull":
        return ~at.missing()
    # text operators take the raw value; matching is by regular expression, so that case folds as Unicode does
    raw = _quoted(p.value or "")
    pattern = {"contains": f"(?iu){raw}", "startswith": f"(?iu)^{raw}", "endswith": f"(?iu){raw}$"}[p.operator]
    return at.matches(pattern)


def _span(at: Resolved, r: Range) -> Column:
    bounds = [at.test(v, _COMPARE[o]) for v, o in ((r.start, "gte"), (r.end, "lte")) if v is not None]
    return reduce(and_, bounds)


def condition(df: DataFrame, plan: Plan) -> Column | None:
    """The conjunction of all predicates and ranges; several paths of one are alternatives, whatever the operator."""
    terms = [reduce(or_, (_one(Resolved(df, path), p) for path in p.paths)) for p in plan.predicates]
    terms += [reduce(or_, (_span(Resolved(df, path), r) for path in r.paths)) for r in plan.ranges]
    return reduce(and_, terms) if terms else None


def filtered(df: DataFrame, plan: Plan) -> DataFrame:
    c = condition(df, plan)
    return df if c is None else df.where(c)


def ordered(df: DataFrame, plan: Plan, tiebreak: str) -> DataFrame:
    """Nulls come first going up and last going down; ``tiebreak`` makes pages repeatable."""
    keys = [k.desc_nulls_last() if down else k.asc_nulls_first() for p, down in plan.order if (at := Resolved(df, p)).kind is not None for k in at.sort_keys()]
    return df.orderBy(*keys, F.col(tiebreak).asc())


def paged(df: DataFrame, plan: Plan, tiebreak: str) -> DataFrame:
    """One page: a top-k of offset + limit rows, never a full sort."""
    return ordered(filtered(df, plan), plan, tiebreak).offset(plan.offset).limit(plan.limit)


def total(df: DataFrame, plan: Plan) -> DataFrame:
    """The number of rows under the page's filter, as one row."""
    return filtered(df, plan).agg(F.count(F.lit(1)).alias("total"))
