"""Operators on rows that are easy to get wrong."""

import base64

import pytest
from pyspark.sql import functions as F

from millrace.functions import crypto, text, times
from millrace.operators import access, calendar, constraints, messaging, state
from millrace.plans import compile, language, projection
from millrace.plans.language import Definition, Field, Unique
from millrace.sources import sinks, tables
from millrace.sources.store import Store


def test_public_projection_makes_lists_of_fields(spark):
    rows = spark.sql("SELECT 1 AS _id, named_struct('a', 'x', 'secret', 's', 'l', array(named_struct('p', 1, 'q', 2), named_struct('p', null, 'q', 3))) AS data")
    d = Definition("k", (Field("a", public=True), Field("p", array_group="l", public=True), Field("secret")), public_get=True)
    assert projection.public(rows, d).select(F.to_json("data")).first()[0] == '{"a":"x","l":{"p":[1]}}'
    assert projection.public(rows, Definition("k")).select("data.secret").first()[0] == "s"


def test_paths_stop_at_lists(spark):
    df = spark.sql("SELECT named_struct('a', array(named_struct('b', 1)), 'c', named_struct('d', 2)) AS data")
    kind = df.schema["data"].dataType
    got = df.select(projection.value_at(F.col("data"), kind, "a.b"), projection.value_at(F.col("data"), kind, "c.d")).first()
    assert tuple(got) == (None, 2)


def test_uniqueness(spark):
    df = spark.createDataFrame([(1, "A", None), (2, "a", None), (3, None, None), (4, None, None), (5, "a", 1)], "id int, n string, s int")
    got = constraints.violations(df, Unique(("n",), ("s",), ignore_case=True)).collect()
    assert [(r["n"], r["s"], r["copies"]) for r in got] == [("a", None, 2)]
    new = spark.createDataFrame([(9, "A", None), (1, "A", None), (8, "b", None)], "id int, n string, s int")
    assert sorted(r["id"] for r in constraints.conflicts(new, df, Unique(("n",), ("s",), ignore_case=True), "id").collect()) == [1, 9]


def test_calendar_text(spark):
    rows = spark.sql("SELECT 1 AS id, 7 AS user_id, DATE '2024-01-15' AS event_date, '9h' AS start_time, null AS end_time, 'a;b,c\\\\d' AS title, ' ' AS description")
    ics = calendar.calendar_text(rows, 7, F.lit("2024-01-01").cast("date"), "20240101T000000", "x.test", "-//P//", "N").first()["ics"]
    assert "DTSTART:20240115T090000\r\n" in ics and "DTEND:20240115T180000\r\n" in ics and "DESCRIPTION" not in ics
    assert "SUMMARY:a\\;b\\,c\\\\d\r\n" in ics and ics.endswith("END:VCALENDAR\r\n")
    empty = calendar.calendar_text(rows.where("id = 0"), 7, F.lit("2024-01-01").cast("date"), "s", "d", "p", "n").first()["ics"]
    assert empty.count("\r\n") == 8


def test_windows(spark):
    day = F.lit("2024-02-29").cast("date")
    for kind, want in {"week": ("2024-02-26", "2024-03-03"), "month": ("2024-02-01", "2024-02-29"), "year": ("2024-01-01", "2024-12-31"), "odd": ("2024-02-29", "2024-02-29")}.items():
        assert tuple(map(str, spark.range(1).select(*times.window_of(kind, day)).first())) == want


@pytest.mark.parametrize("stamp,want", [("2024-01-15 10:00:00", "2024-01-15T10:00Z"), ("2024-01-15 10:00:05", "2024-01-15T10:00:05Z"), ("2024-01-15 10:20:00", "2024-01-15T10:20Z"), ("2024-01-15 10:00:00.5", "2024-01-15T10:00:00.500Z")])
def test_utc_text(spark, stamp, want):
    assert spark.range(1).select(times.utc_text(F.lit(stamp).cast("timestamp_ntz"))).first()[0] == want


def test_crypto_is_null_on_failure(spark):
    key = F.lit("MDEyMzQ1Njc4OTAxMjM0NTY3ODkwMTIzNDU2Nzg5MDE=")
    df = spark.createDataFrame([("hällo",), (None,)], "t string").withColumn("c", crypto.encrypted(F.col("t"), key))
    assert [r[0] for r in df.select(crypto.decrypted(F.col("c"), key)).collect()] == ["hällo", None]
    assert [r[0] for r in df.select(crypto.decrypted(F.lit("???"), key)).collect()] == [None, None]


def test_state_changes(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert sorted(r["v"] for r in state.deleted(now, F.col("k") == 1).collect()) == ["b", "c"]
    up = state.upserted(now, spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string"), ["k"])
    assert sorted(r["v"] for r in up.collect()) == ["B", "C", "a", "c"]
    assert sorted(r["v"] for r in state.ensured(now, spark.createDataFrame([(2, "x"), (9, "y"), (9, "y")], "k int, v string"), ["k"]).collect()) == ["a", "b", "c", "y"]


def test_device_limit_evicts_one(spark):
    devices = spark.createDataFrame([(1, "a", "w", 1), (1, "b", "w", 2), (2, "a", "w", 1)], "user_id int, device_id string, client_type string, created_at int")
    login = spark.createDataFrame([(1, "a", "m", 9)], devices.schema)
    got = {(r["user_id"], r["device_id"], r["created_at"]) for r in state.logged_in(devices, login, 2).collect()}
    assert got == {(1, "b", 2), (1, "a", 9), (2, "a", 1)}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1,)], "k int")
    store.ensure("c", rows.schema)
    assert store.read("c").count() == 0
    store.swap("c", state.inserted(store.read("c"), rows))
    store.swap("c", state.inserted(store.read("c"), rows))
    assert store.read("c").count() == 2 and len(store.versions("c")) == 2
    store.drop("c")
    assert not store.exists("c")
    with pytest.raises(ValueError):
        store.read("../c")


def test_byte_ranges(spark):
    df = spark.createDataFrame([(bytearray(b"0123456789"),)], "c binary")
    for header, want in {"bytes=2-4": b"234", "bytes=7-": b"789", "bytes=-3": b"789", "bytes=5-99": b"56789", None: b"0123456789"}.items():
        assert bytes(df.select(tables.byte_range(F.col("c"), header)).first()[0]) == want


def test_access_rules():
    open_one = Definition("k", active=False, public_get=True)
    assert access.can_read_definition(open_one, []) and not access.can_read_records(open_one, ["k:read"])
    assert access.can_read_records(Definition("k"), ["k:read"]) and not access.can_read_private(Definition("k", public_get=True), [])
    assert not access.can_create(None, ["k:create"]) and access.can_update(Definition("k"), ["k:update"])


def test_reactions_keep_the_order_of_first_use(spark):
    r = spark.createDataFrame([(1, 1, "b", 1), (1, 2, "a", 2), (1, 3, "b", 3)], "message_id int, user_id int, emoji string, created_at int")
    got = messaging.reaction_summary(r, 2).orderBy("rank").collect()
    assert [(x["emoji"], x["n"], x["reacted_by_me"]) for x in got] == [("b", 2, False), ("a", 1, True)]


def test_media_needs_membership(spark):
    files = spark.createDataFrame([("12",), ("123",)], "file_name string")
    msgs = spark.createDataFrame([(1, "/m/123", False), (2, "/m/12", True)], "conversation_id int, media_url string, deleted_for_everyone boolean")
    members = spark.createDataFrame([(1, 7), (2, 7)], "conversation_id int, user_id int")
    assert [r[0] for r in messaging.media_access(files, msgs, members, 7).collect()] == ["123"]


def test_frames_and_seeds(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(sinks.frame("MESSAGE", F.struct("a", "b"))).first()[0] == '{"type":"MESSAGE","payload":{"a":"x"}}'
    seeded = sinks.seeded(df, (df, ["a"]), (spark.createDataFrame([("y", "1")], df.schema), ["a"]))
    assert sorted(r["a"] for r in seeded.collect()) == ["x", "y"]


def test_text(spark):
    df = spark.createDataFrame([("  \t",), (None,), ("a\r\nb;",)], "t string")
    got = df.select(text.or_null(F.col("t")), text.calendar_escaped(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(None, "  \t"), (None, ""), ("a\r\nb;", "a\\nb\\;")]


def test_claims_and_audit(spark):
    users = spark.createDataFrame([(1, "e", "n", "r")], "id int, email string, full_name string, role string")
    none = spark.createDataFrame([], "owner_id int, authorities array<string>")
    got = access.claims(users, none, F.lit("2024-01-01 00:00:00").cast("timestamp"), 5).first()
    assert got["authorities"] == [] and got["sub"] == "1" and (got["exp"] - got["iat"]).seconds == 300
    rows = spark.createDataFrame([(None, None, None)], "createdAt timestamp, updatedAt timestamp, createdBy string")
    assert state.audited(rows, F.lit("2024-01-01").cast("timestamp"), None).first()["createdBy"] == "system"


# --- plans ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("params", "pushed"),
    [
        ({"o_orderstatus_eq": "O"}, "EqualTo(o_orderstatus,O)"),
        ({"o_orderstatus_neq": "O"}, "Not(EqualNullSafe(o_orderstatus,O))"),
        ({"o_orderkey_in": "1,2,3"}, "In(o_orderkey, [1,2,3])"),
        ({"o_orderkey_nin": "1,2,3"}, "Or(IsNull(o_orderkey),Not(In(o_orderkey, [1,2,3])))"),
        ({"o_totalprice_gte": "10.5"}, "GreaterThanOrEqual(o_totalprice,10.5)"),
        ({"o_orderkey_betweenstart": "5", "o_orderkey_betweenend": "9"}, "LessThanOrEqual(o_orderkey,9)"),
        ({"o_orderstatus_isnull": ""}, "IsNull(o_orderstatus)"),
        ({"o_orderstatus_isnotnull": ""}, "IsNotNull(o_orderstatus)"),
    ],
)
def test_predicates_reach_the_scan(spark, params, pushed):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = compile.filtered(orders, language.plan(params, prefix=""))._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan.split("PushedFilters: ")[1].split("], Read")[0]


def test_times_reach_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = compile.filtered(events, language.plan({"ts_gte": "2024-01-15"}, prefix=""))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-15" in plan


def test_conflicts_of_lists_are_a_hashed_join(spark):
    df = spark.createDataFrame([(1, ["A", "b"]), (2, ["B"]), (3, ["c"]), (4, None), (5, [])], "id long, tags array<string>")
    found = constraints.conflicts(df, df, Unique(("tags",), ignore_case=True), "id")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in found.collect()) == [1, 2]
    assert [r["id"] for r in constraints.conflicts(df, df, Unique(("tags",)), "id").collect()] == []


def test_unknown_paths_of_a_rule_are_errors(spark):
    with pytest.raises(ValueError):
        constraints.violations(spark.range(3), Unique(("nothing",)))


def test_codes_and_keys(spark):
    codes = [r[0] for r in spark.range(200).select(crypto.code(8).alias("c")).collect()]
    assert len(set(codes)) > 190 and all(len(c) == 8 and set(c) <= set(crypto.SYMBOLS) for c in codes) and len(set("".join(codes))) > 55
    assert len(base64.b64decode(crypto.new_key())) == 32 and crypto.new_key() != crypto.new_key()
