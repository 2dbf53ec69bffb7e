"""The suffix query language: one request parameter a predicate, ``<path><suffix>=<value>``.

Parsing is plain Python and knows nothing of Spark. The semantics that surprise:
literals are inferred (boolean, then double where there is a point, then long, then
string), any name that ends in a suffix is a predicate, unknown names are ignored, and
both ends of a range are inclusive.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

# Fixed values of the language.
SUFFIXES = {
    "_eq": "eq",
    "_neq": "neq",
    "_contains": "contains",
    "_startswith": "startswith",
    "_endswith": "endswith",
    "_gt": "gt",
    "_gte": "gte",
    "_lt": "lt",
    "_lte": "lte",
    "_in": "in",
    "_nin": "nin",
    "_betweenstart": "betweenstart",
    "_betweenend": "betweenend",
    "_isnull": "isnull",
    "_isnotnull": "isnotnull",
}
RESERVED = frozenset({"sort.key", "sort.dir", "page", "pageSize", "offset", "take", "language"})
SYSTEM_FIELDS = frozenset({"createdAt", "updatedAt", "createdBy", "_id"})
TEXT_OPERATORS = frozenset({"contains", "startswith", "endswith"})
DEFAULT_PAGE, MAX_PAGE = 10, 200

Literal = bool | float | int | str

_LONG = re.compile(r"[+-]?[0-9]+\Z")
_DOUBLE = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?\Z")
_LANGUAGE = re.compile(r"[A-Za-z-]+\Z")
_LOW = "".join(map(chr, range(33)))


def literal(value: str | None) -> Literal | None:
    """The typed value of a parameter: "007" is 7, "1.5f" is 1.5, "1e5" and "2024.01.01" stay text."""
    if value is None:
        return None
    text = value.strip(_LOW)
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if "." in text:
        return float(text.rstrip("fFdD")) if _DOUBLE.match(text) else text
    if _LONG.match(text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    return text


def literals(value: str | None) -> list[Literal]:
    """A comma list; blank is no value, and empty items at its end are dropped."""
    if value is None or not value.strip():
        return []
    parts = value.split(",")
    while parts and parts[-1] == "":
        parts.pop()
    return [literal(p) for p in parts]


def operator_of(name: str) -> tuple[str, str] | None:
    """(path, operator) of a parameter's name, by its longest suffix."""
    for suffix in sorted(SUFFIXES, key=len, reverse=True):
        if name.endswith(suffix):
            return name[: -len(suffix)], SUFFIXES[suffix]
    return None


@dataclass(frozen=True)
class Field:
    """A declared field; declarations steer paths and projections, they coerce nothing."""

    key: str
    group: str | None = None
    array_group: str | None = None
    public: bool = False
    avoid_translate: bool = False

    @property
    def path(self) -> str:
        for outer in (self.group, self.array_group):
            if outer and outer.strip():
                return f"{outer}.{self.key}"
        return self.key


@dataclass(frozen=True)
class Unique:
    fields: tuple[str, ...]
    scope: tuple[str, ...] = ()
    ignore_case: bool = False


@dataclass(frozen=True)
class Definition:
    """What an entity allows. A missing permission counts as false."""

    key: str
    fields: tuple[Field, ...] = ()
    unique: tuple[Unique, ...] = ()
    active: bool | None = True
    allow_filters: bool | None = None
    allow_search: bool | None = None
    allow_sort: bool | None = None
    public_get: bool | None = None
    public_post: bool | None = None
    public_put: bool | None = None
    default_sort: tuple[str, str] | None = None


@dataclass(frozen=True)
class Predicate:
    paths: tuple[str, ...]
    operator: str
    value: str | None = None


@dataclass(frozen=True)
class Range:
    paths: tuple[str, ...]
    start: Literal | None = None
    end: Literal | None = None


@dataclass(frozen=True)
class Plan:
    predicates: tuple[Predicate, ...] = ()
    ranges: tuple[Range, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()  # path, descending
    offset: int = 0
    limit: int = DEFAULT_PAGE


@dataclass
class Resolver:
    """Paths of fields: those of the system stand alone, others lie in ``data`` and may have a translation."""

    language: str | None = None
    avoid: Mapping[str, bool] = field(default_factory=dict)
    prefix: str = "data."

    def __post_init__(self) -> None:
        if self.language and self.language.strip() and not _LANGUAGE.match(self.language):
            raise ValueError("a language is letters and hyphens")

    def paths(self, raw: str) -> tuple[str, ...]:
        system = not self.prefix or raw in SYSTEM_FIELDS
        path = raw if system or not raw.strip() or raw.startswith(self.prefix) else self.prefix + raw
        if not self.language or not self.language.strip() or system or self.avoid.get(path.removeprefix(self.prefix)):
            return (path,)
        return (f"{path}.{self.language}", path)


def _int(value: str | None) -> int | None:
    return int(value) if value and _LONG.match(value) and abs(int(value)) < 1 << 31 else None


def page(params: Mapping[str, str]) -> tuple[int, int]:
    """(offset, limit): offset and take before page and pageSize; at most MAX_PAGE, a size below 1 is the default."""
    size = lambda n: DEFAULT_PAGE if n is None or n <= 0 else min(n, MAX_PAGE)
    offset, take = _int(params.get("offset")), _int(params.get("take"))
    if offset is not None or take is not None:
        return max(0, offset or 0), size(take)
    number, length = _int(params.get("page")), size(_int(params.get("pageSize")))
    return max(0, number or 0) * length, length


def plan(params: Mapping[str, str], definition: Definition | None = None, prefix: str = "data.") -> Plan:
    """The plan of a request. Without ``definition`` nothing is gated and nothing translated."""
    gate = lambda name: definition is None or getattr(definition, name) is True
    language = params.get("language") if definition is not None else None
    at = Resolver(language, {f.path: f.avoid_translate for f in definition.fields} if definition else {}, prefix)
    predicates: list[Predicate] = []
    ranges: dict[str, dict[str, Literal | None]] = {}
    for name, value in params.items() if gate("allow_filters") else ():
        found = None if name in RESERVED else operator_of(name)
        if found is None or (found[1] in TEXT_OPERATORS and not gate("allow_search")):
            continue
        path, operator = found
        if operator.startswith("between"):
            ranges.setdefault(path, {})[operator.removeprefix("between")] = literal(value)
        else:
            predicates.append(Predicate(at.paths(path), operator, value))
    order: tuple[tuple[str, bool], ...] = ()
    if gate("allow_sort"):
        key, direction = params.get("sort.key"), params.get("sort.dir")
        if not key or not key.strip():
            key, direction = (definition.default_sort if definition and definition.default_sort and definition.default_sort[0].strip() else (None, None))
        down = (direction or "").lower() == "desc"
        order = tuple((p, down) for p in at.paths(key)) if key else (("createdAt", True),)
    offset, limit = page(params)
    spans = tuple(Range(at.paths(p), b.get("start"), b.get("end")) for p, b in ranges.items() if b.get("start") is not None or b.get("end") is not None)
    return Plan(tuple(predicates), spans, order, offset, limit)
