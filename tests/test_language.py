"""The suffix language: parsing by tables, compiled predicates against a plain evaluator."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans import compile as plans
from millrace.plans import language
from millrace.plans.language import Definition, Field, literal, literals, operator_of, page, plan


@pytest.mark.parametrize(
    "text,value",
    [("00123", 123), ("+5", 5), ("1e5", "1e5"), ("1.5f", 1.5), ("2024.01.01", "2024.01.01"), ("9" * 20, "9" * 20), ("", ""), (" TRUE ", True), ("\tx\n", "x"), (".", "."), ("1.", 1.0), (None, None), ("-7", -7)],
)
def test_literals(text, value):
    assert literal(text) == value and type(literal(text)) is type(value)


def test_lists():
    assert literals("1, a ,true,,") == [1, "a", True]
    assert literals("  ") == [] and literals(None) == []


def test_operators_by_longest_suffix():
    assert operator_of("check_in") == ("check", "in")
    assert operator_of("check_in_eq") == ("check_in", "eq")
    assert operator_of("a_isnotnull") == ("a", "isnotnull")
    assert operator_of("a_nin") == ("a", "nin")
    assert operator_of("a_EQ") is None and operator_of("a") is None


def test_pages():
    assert page({}) == (0, 10)
    assert page({"page": "2", "pageSize": "500"}) == (400, 200)
    assert page({"page": "-1", "pageSize": "0"}) == (0, 10)
    assert page({"offset": "7", "page": "9"}) == (7, 10)
    assert page({"take": "x", "offset": "y", "page": "1"}) == (10, 10)


def test_gates():
    asked = {"a_eq": "1", "b_contains": "x", "sort.key": "a"}
    assert plan(asked, Definition("k")).predicates == () and plan(asked, Definition("k")).order == ()
    assert [p.operator for p in plan(asked, Definition("k", allow_filters=True)).predicates] == ["eq"]
    assert len(plan(asked, Definition("k", allow_filters=True, allow_search=True)).predicates) == 2
    assert plan({}, Definition("k", allow_sort=True)).order == (("createdAt", True),)
    assert plan({}, Definition("k", allow_sort=True, default_sort=("a", "DESC"))).order == (("data.a", True),)


def test_languages():
    d = Definition("k", (Field("code", avoid_translate=True),), allow_filters=True, allow_sort=True)
    got = plan({"title_eq": "x", "code_eq": "y", "createdAt_gt": "z", "language": "en", "sort.key": "title"}, d)
    assert [p.paths for p in got.predicates] == [("data.title.en", "data.title"), ("data.code",), ("createdAt",)]
    assert got.order == (("data.title.en", False), ("data.title", False))
    with pytest.raises(ValueError):
        plan({"language": "a.b"}, d)


ROWS = [(1, "abc", 5, [1, 2]), (2, "ABC_1", None, None), (3, None, 7, []), (4, "x%y", -3, [7]), (5, "Ștefan", 5, [None, 5]), (6, "abc\n", 0, [0])]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id int, s string, n int, a array<int>").cache()


def evaluate(row, field, op, value):
    v = row[{"s": 1, "n": 2, "a": 3}[field]]
    want = literal(value)
    fits = lambda x: x is not None and isinstance(x, str) == isinstance(want, str) and not isinstance(want, bool)
    compare = {"eq": lambda x: x == want, "gt": lambda x: x > want, "gte": lambda x: x >= want, "lt": lambda x: x < want, "lte": lambda x: x <= want}
    items = v if isinstance(v, list) else [v]
    if op in compare:
        return any(fits(x) and compare[op](x) for x in items or [])
    if op == "neq":
        return not evaluate(row, field, "eq", value)
    if op == "in":
        return any(fits_any(x, w) for x in items or [] for w in literals(value))
    if op == "nin":
        return not evaluate(row, field, "in", value)
    if op == "isnull":
        return v is None
    if op == "isnotnull":
        return v is not None
    if not isinstance(v, str):
        return False
    pattern = {"contains": re.escape(value), "startswith": "^" + re.escape(value), "endswith": re.escape(value) + "$"}[op]
    return re.search(pattern, v, re.I) is not None


def fits_any(x, w):
    return x is not None and isinstance(x, str) == isinstance(w, str) and not isinstance(w, bool) and x == w


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sampled_from(["s", "n", "a"]), st.sampled_from(sorted(set(language.SUFFIXES.values()) - {"betweenstart", "betweenend"})), st.sampled_from(["abc", "ABC", "5", "007", "x%", "_1", "true", "", "5,7,abc", "ștefan", "c", "\\E"]))
def test_predicates(frame, field, op, value):
    got = {r["id"] for r in plans.filtered(frame, plan({f"{field}_{op}": value}, prefix="")).collect()}
    assert got == {r[0] for r in ROWS if evaluate(r, field, op, value)}


def test_ranges_and_missing_paths(frame):
    ids = lambda p: {r["id"] for r in plans.filtered(frame, plan(p, prefix="")).collect()}
    assert ids({"n_betweenstart": "0", "n_betweenend": "5"}) == {1, 5, 6}
    assert ids({"n_betweenend": "0"}) == {4, 6}
    assert ids({"nowhere_eq": "1"}) == set() and ids({"nowhere_neq": "1"}) == {1, 2, 3, 4, 5, 6}
    assert ids({"nowhere_isnull": ""}) == {1, 2, 3, 4, 5, 6}


def test_variant_classes(spark):
    rows = [(1, '{"k": "00123", "t": {"en": "x"}}'), (2, '{"k": 123}'), (3, '{"k": [5, 123]}'), (4, "{}"), (5, '{"k": null}'), (6, '{"k": 1.5}'), (7, '{"k": true}')]
    df = spark.createDataFrame(rows, "id int, j string").select("id", F.parse_json("j").alias("data"))
    ids = lambda p: {r["id"] for r in plans.filtered(df, plan(p)).collect()}
    assert ids({"k_eq": "00123"}) == {2, 3}
    assert ids({"k_contains": "12"}) == {1}
    assert ids({"k_isnull": ""}) == {4, 5}
    assert ids({"k_lt": "2"}) == {6}
    assert ids({"k_eq": "true"}) == {7}
    assert ids({"k_neq": "123"}) == {1, 4, 5, 6, 7}
    assert ids({"t.en_eq": "x"}) == {1}


def test_times_compare_with_text(spark):
    df = spark.sql("SELECT 1 AS _id, TIMESTAMP '2024-01-02' AS createdAt UNION ALL SELECT 2, TIMESTAMP '2023-01-02'")
    assert [r["_id"] for r in plans.filtered(df, plan({"createdAt_gt": "2024-01-01"})).collect()] == [1]
    assert isinstance(df.schema["createdAt"].dataType, T.TimestampType)
