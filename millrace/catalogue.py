"""Every query of the library, with the SQL that says the same.

The tables are the driver's; ``_shapes`` derives conversations, members, receipts and
calendar events from them, and ``_SHAPES`` says the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import crypto, text, times
from millrace.operators import access, calendar, constraints, messaging, state
from millrace.plans import compile as plans
from millrace.plans import language, projection
from millrace.plans.language import Definition, Field, Unique
from millrace.sources import sinks, tables
from millrace.sources.tables import table
from millrace.streaming import frames, runs

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}

USER = 1


def _query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _ALL[name] = (f, sql)
        return f

    return put


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}


# --- the record language -------------------------------------------------------------


def _where(name: str, columns: list[str], params: dict[str, str], spark: SparkSession, d: str) -> DataFrame:
    return plans.filtered(table(spark, d, name), language.plan(params, prefix="")).select(*columns)


def _filters() -> None:
    events, orders, part = ["event_id", "event_type", "value"], ["o_orderkey", "o_orderstatus", "o_totalprice"], ["p_partkey", "p_name"]
    cases = {
        "filter_eq": ("events", events, {"event_type_eq": "click"}, "event_type = 'click'"),
        "filter_neq": ("events", events, {"event_type_neq": "click"}, "event_type IS DISTINCT FROM 'click'"),
        "filter_gt": ("events", events, {"value_gt": "10.5"}, "value > 10.5"),
        "filter_gte": ("orders", orders, {"o_custkey_gte": "100"}, "o_custkey >= 100"),
        "filter_lt": ("events", events, {"value_lt": "10"}, "value < 10"),
        "filter_lte": ("orders", orders, {"o_orderkey_lte": "500"}, "o_orderkey <= 500"),
        "filter_and": ("events", events, {"event_type_eq": "click", "value_gte": "10", "unknown": "x", "value_lt": "90.0"}, "event_type = 'click' AND value >= 10 AND value < 90"),
        "filter_contains": ("part", part, {"p_name_contains": "A"}, "regexp_matches(p_name, 'a', 'i')"),
        "filter_startswith": ("part", part, {"p_name_startswith": "B"}, "regexp_matches(p_name, '^b', 'i')"),
        "filter_endswith": ("part", part, {"p_name_endswith": "E"}, "regexp_matches(p_name, 'e$', 'i')"),
        "filter_in": ("orders", orders, {"o_orderstatus_in": "O, F"}, "o_orderstatus IN ('O', 'F')"),
        "filter_nin": ("orders", orders, {"o_orderkey_nin": "1,2,3"}, "coalesce(o_orderkey IN (1, 2, 3), false) = false"),
        "filter_between": ("orders", orders, {"o_orderkey_betweenstart": "100", "o_orderkey_betweenend": "200"}, "o_orderkey >= 100 AND o_orderkey <= 200"),
        "filter_between_open": ("orders", orders, {"o_totalprice_betweenstart": "100000.0"}, "o_totalprice >= 100000"),
    }
    for name, (source, columns, params, sql) in cases.items():
        _ALL[name] = (partial(_where, source, columns, params), f"SELECT {', '.join(columns)} FROM {source} WHERE {sql}")


_filters()


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels; most have none. Labels have one row a document."""
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left")


@_query("filter_isnull", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL")
def filter_isnull(spark: SparkSession, d: str) -> DataFrame:
    return plans.filtered(_labelled(spark, d), language.plan({"quality_isnull": ""}, prefix="")).select("doc_id")


@_query("filter_isnotnull", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL")
def filter_isnotnull(spark: SparkSession, d: str) -> DataFrame:
    return plans.filtered(_labelled(spark, d), language.plan({"quality_isnotnull": ""}, prefix="")).select("doc_id", "quality")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("_id"), F.parse_json("props").alias("data"))


@_query("variant_gt", "SELECT event_id AS _id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50")
def variant_gt(spark: SparkSession, d: str) -> DataFrame:
    return plans.filtered(_records(spark, d), language.plan({"k_gt": "50"})).select("_id")


@_query("variant_eq", "SELECT event_id AS _id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def variant_eq(spark: SparkSession, d: str) -> DataFrame:
    return plans.filtered(_records(spark, d), language.plan({"k_eq": "007"})).select("_id")


@_query("variant_bracketed", "SELECT event_id AS _id FROM events WHERE false")
def variant_bracketed(spark: SparkSession, d: str) -> DataFrame:
    """A number is not a text: nothing is found, and nothing fails."""
    return plans.filtered(_records(spark, d), language.plan({"k_contains": "7"})).select("_id")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Records whose field v is a number, a text, a list of texts, or missing."""
    o = table(spark, d, "orders")
    kind, number = F.col("o_orderkey") % 4, F.col("o_totalprice").cast("long")
    fields = F.when(kind == 0, F.to_json(F.struct(number.alias("v")))).when(kind == 1, F.to_json(F.struct(F.col("o_orderpriority").alias("v"))))
    fields = fields.when(kind == 2, F.to_json(F.struct(F.array("o_orderstatus", "o_orderpriority").alias("v")))).otherwise(F.lit('{"w": {"v": 1}}'))
    return o.select(F.col("o_orderkey").alias("_id"), F.parse_json(fields).alias("data"))


@_query(
    "variant_sort",
    """SELECT o_orderkey AS _id FROM orders ORDER BY CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 END NULLS FIRST,
       CASE WHEN o_orderkey % 4 = 0 THEN trunc(o_totalprice) END, CASE o_orderkey % 4 WHEN 1 THEN o_orderpriority
       WHEN 2 THEN '["' || o_orderstatus || '","' || o_orderpriority || '"]' END, o_orderkey LIMIT 100 OFFSET (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 3)""",
)
def variant_sort(spark: SparkSession, d: str) -> DataFrame:
    plan = language.plan({"sort.key": "v"})
    missing = table(spark, d, "orders").where("o_orderkey % 4 = 3").count()
    return plans.ordered(_mixed(spark, d), plan, "_id").offset(missing).limit(100).select("_id")


@_query("variant_contains_list", "SELECT o_orderkey AS _id FROM orders WHERE o_orderkey % 4 IN (1, 2) AND regexp_matches(o_orderpriority, 'urg', 'i')")
def variant_contains_list(spark: SparkSession, d: str) -> DataFrame:
    return plans.filtered(_mixed(spark, d), language.plan({"v_contains": "URG"})).select("_id")


@_query(
    "variant_public",
    """SELECT o_orderkey AS _id, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) WHEN 1 THEN o_orderpriority END AS v,
       CASE WHEN o_orderkey % 4 = 2 THEN 2 END AS n_items, CASE WHEN o_orderkey % 4 = 3 THEN 1 END AS inner_v FROM orders""",
)
def variant_public(spark: SparkSession, d: str) -> DataFrame:
    definition = Definition("mixed", (Field("v", public=True), Field("v", group="w", public=True), Field("x")), public_get=True)
    seen = projection.public(_mixed(spark, d), definition)
    value = F.try_variant_get("data", "$.v", "variant")
    return seen.select(
        "_id",
        F.when(~F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get("data", "$.v", "string")).alias("v"),
        F.size(F.try_variant_get("data", "$.v", "array<variant>")).alias("n_items"),
        F.try_variant_get("data", "$.w.v", "int").alias("inner_v"),
    )


@_query(
    "variant_unique",
    """SELECT o_orderkey AS _id FROM orders o WHERE o_orderkey % 4 IN (1, 2) AND (SELECT count(*) FROM orders p WHERE p.o_orderkey % 4 IN (1, 2) AND p.o_orderpriority = o.o_orderpriority) > 1
       OR o_orderkey % 4 = 2 AND (SELECT count(*) FROM orders p WHERE p.o_orderkey % 4 = 2 AND p.o_orderstatus = o.o_orderstatus) > 1
       OR o_orderkey % 4 = 0 AND (SELECT count(*) FROM orders p WHERE p.o_orderkey % 4 = 0 AND trunc(p.o_totalprice) = trunc(o.o_totalprice)) > 1""",
)
def variant_unique(spark: SparkSession, d: str) -> DataFrame:
    records = _mixed(spark, d)
    return constraints.conflicts(records, records, Unique(("data.v",), ignore_case=True), "_id").select("_id")


@_query("variant_violations", "SELECT CAST(trunc(o_totalprice) AS DOUBLE) AS v, count(*) AS copies FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL HAVING count(*) > 1")
def variant_violations(spark: SparkSession, d: str) -> DataFrame:
    found = constraints.violations(_mixed(spark, d), Unique(("data.v",)))
    return found.where(F.col("data_v").startswith("n:")).select(F.substring("data_v", 3, 40).cast("double").alias("v"), "copies")


_TRANSLATED = Definition("docs", (Field("title"),), allow_filters=True, allow_search=True, allow_sort=True)


def _titles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("_id"), F.struct(F.create_map("lang", "source").alias("title")).alias("data"))


@_query("lang_overlay", "SELECT doc_id AS _id FROM documents WHERE lang = 'de' AND regexp_matches(source, '^SRC1', 'i')")
def lang_overlay(spark: SparkSession, d: str) -> DataFrame:
    return plans.filtered(_titles(spark, d), language.plan({"title_startswith": "SRC1", "language": "de"}, _TRANSLATED)).select("_id")


@_query("lang_sort", "SELECT doc_id AS _id FROM documents ORDER BY CASE WHEN lang = 'fr' THEN source END DESC NULLS LAST, doc_id LIMIT 25")
def lang_sort(spark: SparkSession, d: str) -> DataFrame:
    plan = language.plan({"sort.key": "title.fr", "sort.dir": "DESC", "take": "25"}, _TRANSLATED)
    return plans.paged(_titles(spark, d), plan, "_id").select("_id")


@_query("page_sorted", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
def page_sorted(spark: SparkSession, d: str) -> DataFrame:
    plan = language.plan({"o_orderstatus_eq": "O", "sort.key": "o_totalprice", "sort.dir": "desc", "page": "2", "pageSize": "20"}, prefix="")
    return plans.paged(table(spark, d, "orders"), plan, "o_orderkey").select("o_orderkey", "o_totalprice")


@_query("page_capped", "SELECT o_orderkey FROM orders ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 200 OFFSET 5")
def page_capped(spark: SparkSession, d: str) -> DataFrame:
    plan = language.plan({"sort.key": "o_orderdate", "offset": "5", "take": "999"}, prefix="")
    return plans.paged(table(spark, d, "orders"), plan, "o_orderkey").select("o_orderkey")


@_query("page_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'")
def page_total(spark: SparkSession, d: str) -> DataFrame:
    return plans.total(table(spark, d, "orders"), language.plan({"o_orderstatus_eq": "O", "take": "3"}, prefix=""))


_FLAGSHIP = {"event_type_eq": "click", "value_gte": "10", "sort.key": "value", "sort.dir": "desc", "take": "10"}


@_query("flagship", "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND value >= 10 ORDER BY value DESC NULLS LAST, event_id LIMIT 10")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    return plans.paged(table(spark, d, "events"), language.plan(_FLAGSHIP, prefix=""), "event_id").select("event_id", "event_type", "value")


_ORDER = Definition(
    "orders",
    (Field("status", public=True), Field("total"), Field("partkey", array_group="lines", public=True), Field("name", group="customer", public=True)),
    public_get=True,
)


def _order_records(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    listed = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("quantity")))).alias("lines"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("customer"))
    wide = orders.join(listed, "o_orderkey").join(customers, "o_custkey")
    return wide.select(F.col("o_orderkey").alias("_id"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), "lines", "customer").alias("data"))


@_query(
    "public_projection",
    """SELECT o_orderkey AS _id, o_orderstatus AS status, c_name AS name, array_to_string(list(l_partkey ORDER BY l_partkey), ',') AS parts
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL""",
)
def public_projection(spark: SparkSession, d: str) -> DataFrame:
    seen = projection.public(_order_records(spark, d), _ORDER)
    return seen.select("_id", "data.status", "data.customer.name", F.array_join(F.col("data.lines.partkey").cast("array<string>"), ",").alias("parts"))


@_query("public_items", "SELECT doc_id, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS n FROM documents")
def public_items(spark: SparkSession, d: str) -> DataFrame:
    items = F.array(F.struct(F.lit("a").alias("key"), (F.col("n_chars") > 1000).alias("public")), F.struct(F.lit("b").alias("key"), F.lit(None).cast("boolean").alias("public")))
    return table(spark, d, "documents").select("doc_id", F.size(projection.public_items(items, "public")).alias("n"))


@_query("map_merge", "SELECT event_id, event_type AS a, 'new' AS b, CAST(user_id AS VARCHAR) AS c FROM events")
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    old = F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("old"))
    new = F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.col("user_id").cast("string"))
    return table(spark, d, "events").withColumn("m", projection.merged(old, new)).select("event_id", F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("m.c").alias("c"))


# --- constraints ---------------------------------------------------------------------


@_query("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return constraints.violations(table(spark, d, "lineitem"), Unique(("l_orderkey", "l_linenumber")))


@_query("unique_violations_ci", "SELECT lower(p_name) AS p_name, count(*) AS copies FROM part WHERE p_name IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def unique_violations_ci(spark: SparkSession, d: str) -> DataFrame:
    return constraints.violations(table(spark, d, "part"), Unique(("p_name",), ignore_case=True))


@_query(
    "unique_violations_scoped",
    """SELECT d.source, l.quality, count(*) AS copies FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
       WHERE d.source IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
)
def unique_violations_scoped(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return constraints.violations(table(spark, d, "documents").select("doc_id", "source").join(labels, "doc_id", "left"), Unique(("source",), ("quality",)))


@_query(
    "unique_conflicts",
    """SELECT n.p_partkey FROM part n WHERE EXISTS
       (SELECT 1 FROM part e WHERE lower(e.p_name) = lower(n.p_name) AND e.p_brand IS NOT DISTINCT FROM n.p_brand AND e.p_partkey <> n.p_partkey)""",
)
def unique_conflicts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    rule = Unique(("p_name",), ("p_brand",), ignore_case=True)
    return constraints.conflicts(part, part, rule, "p_partkey").select("p_partkey")


# --- messaging -----------------------------------------------------------------------

_SHAPES = """WITH messages AS (
  SELECT conv_id * 100 + turn AS id, conv_id AS conversation_id, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS sender_id,
    text AS content, (conv_id + turn) % 7 = 0 AS deleted_for_everyone, CASE WHEN turn >= 2 THEN conv_id * 100 + turn - 2 END AS replied_to_msg_id
  FROM conversations
), convs AS (
  SELECT DISTINCT conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 'GROUP' ELSE 'DIRECT' END AS type, 'Topic ' || conv_id AS title,
    CASE WHEN conv_id % 4 = 0 THEN conv_id % 3 + 1 END AS course_id, 'pic' || conv_id AS avatar_url
  FROM conversations
), members AS (
  SELECT id AS conversation_id, unnest(CASE WHEN type = 'DIRECT' THEN [1, 2 + id % 5] ELSE [1, 2, 3] END) AS user_id FROM convs WHERE id % 10 <> 9
), receipts AS (
  SELECT id AS conversation_id, 1 AS user_id, id * 100 + id % 4 AS last_message_id FROM convs WHERE id % 3 <> 0
), users AS (
  SELECT c_custkey AS id, c_name AS full_name, 'face' || c_custkey AS avatar_url FROM customer
) """


class _shapes:
    def __init__(self, spark: SparkSession, d: str) -> None:
        c = table(spark, d, "conversations")
        base = F.col("conv_id") * 100
        sender = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3).cast("long")
        self.messages = c.select(
            (base + F.col("turn")).alias("id"),
            F.col("conv_id").alias("conversation_id"),
            sender.alias("sender_id"),
            F.col("text").alias("content"),
            ((F.col("conv_id") + F.col("turn")) % 7 == 0).alias("deleted_for_everyone"),
            F.when(F.col("turn") >= 2, base + F.col("turn") - 2).alias("replied_to_msg_id"),
        )
        i = F.col("id")
        self.conversations = c.select(F.col("conv_id").alias("id")).distinct().select(
            "id",
            F.when(i % 2 == 0, "GROUP").otherwise("DIRECT").alias("type"),
            F.concat(F.lit("Topic "), i.cast("string")).alias("title"),
            F.when(i % 4 == 0, i % 3 + 1).alias("course_id"),
            F.concat(F.lit("pic"), i.cast("string")).alias("avatar_url"),
        )
        one, two, three = (F.lit(n).cast("long") for n in (1, 2, 3))
        people = F.when(F.col("type") == "DIRECT", F.array(one, two + i % 5)).otherwise(F.array(one, two, three))
        self.members = self.conversations.where("id % 10 != 9").select(i.alias("conversation_id"), F.explode(people).alias("user_id"))
        self.receipts = self.conversations.where("id % 3 != 0").select(i.alias("conversation_id"), one.alias("user_id"), (i * 100 + i % 4).alias("last_message_id"))
        u = table(spark, d, "customer")
        self.users = u.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.concat(F.lit("face"), F.col("c_custkey").cast("string")).alias("avatar_url"))
        self.courses = u.select(F.col("c_custkey").alias("id"), F.concat(F.lit("course"), F.col("c_custkey").cast("string")).alias("avatar_url"))


#: By conversation of the user, the messages beyond the receipt: receipts grouped and joined.
_UNREAD = """, seen AS (
  SELECT conversation_id, max(last_message_id) AS upto FROM receipts WHERE user_id = 1 GROUP BY conversation_id
), news AS (
  SELECT conversation_id, id FROM (SELECT * FROM messages SEMI JOIN (FROM members WHERE user_id = 1) USING (conversation_id)) LEFT JOIN seen USING (conversation_id)
  WHERE sender_id <> 1 AND deleted_for_everyone IS FALSE AND (upto IS NULL OR id > upto)
)"""


@_query("unread_total", f"{_SHAPES}{_UNREAD} SELECT count(*) AS total FROM news")
def unread_total(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    return messaging.unread_total(s.messages, s.members, s.receipts, USER)


@_query("unread_by_conv", f"{_SHAPES}{_UNREAD} SELECT conversation_id, count(*) AS unread_count FROM news GROUP BY conversation_id")
def unread_by_conv(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    return messaging.unread_counts(s.messages, s.members, s.receipts, USER)


@_query("unread_map", f"{_SHAPES}{_UNREAD} SELECT count(DISTINCT conversation_id) AS n, CAST(count(*) AS BIGINT) AS total FROM news")
def unread_map(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    counts = projection.as_map(messaging.unread_counts(s.messages, s.members, s.receipts, USER), "conversation_id", "unread_count", "m")
    return counts.select(F.size("m").cast("long").alias("n"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


#: The two kinds of conversations are found one by one and put together.
_SEARCH = """{s}, found AS (
  SELECT id FROM convs WHERE type = 'GROUP' AND regexp_matches(title, '{q}', 'i')
  UNION
  SELECT conversation_id FROM (FROM members WHERE user_id <> 1) p JOIN users ON users.id = p.user_id AND regexp_matches(full_name, '{q}', 'i')
    JOIN (SELECT id AS conversation_id FROM convs WHERE type = 'DIRECT') USING (conversation_id)
) SELECT id, type, title FROM convs SEMI JOIN found USING (id) SEMI JOIN (SELECT conversation_id AS id FROM members WHERE user_id = 1) USING (id)"""


@_query("conversation_search", _SEARCH.format(s=_SHAPES, q="c 1"))
def conversation_search(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    return messaging.search(s.conversations, s.members, s.users, USER, "c 1").select("id", "type", "title")


@_query("conversation_search_name", _SEARCH.format(s=_SHAPES, q="0003"))
def conversation_search_name(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    return messaging.search(s.conversations, s.members, s.users, USER, "0003").select("id", "type", "title")


@_query("conversation_page", f"{_SHAPES} SELECT c.id FROM convs c JOIN members m ON m.conversation_id = c.id WHERE m.user_id = 1 ORDER BY c.course_id DESC NULLS FIRST, c.id LIMIT 20")
def conversation_page(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    mine = messaging.conversations_of(s.conversations, s.members, USER).withColumns({"last_message_at": F.col("course_id"), "created_at": F.lit(None).cast("long")})
    return mine.orderBy(*messaging.by_activity()).limit(20).select("id")


@_query("conversation_total", f"{_SHAPES} SELECT count(*) AS total FROM convs c JOIN members m ON m.conversation_id = c.id WHERE m.user_id = 1")
def conversation_total(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    return messaging.search(s.conversations, s.members, s.users, USER, "").agg(F.count(F.lit(1)).alias("total"))


@_query(
    "direct_between",
    f"""{_SHAPES} SELECT id FROM convs JOIN members ON conversation_id = id AND user_id IN (1, 3)
        WHERE type = 'DIRECT' GROUP BY id HAVING count(DISTINCT user_id) = 2""",
)
def direct_between(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    return messaging.direct_between(s.conversations, s.members, 1, 3).select("id")


#: Members paired with members of the same direct conversation, seen from user 1.
_PARTNERS = """SELECT other.user_id FROM members me JOIN members other USING (conversation_id) JOIN convs ON convs.id = conversation_id
  WHERE me.user_id = 1 AND other.user_id <> 1 AND type = 'DIRECT'"""


@_query("partners", f"{_SHAPES} {_PARTNERS}")
def partners(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    return messaging.direct_partners(s.conversations, s.members, USER)


@_query("contacts", f"{_SHAPES} SELECT u.id AS user_id, u.full_name FROM users u WHERE u.id <> 1 AND u.id NOT IN ({_PARTNERS}) AND contains(lower(u.full_name), '1')")
def contacts(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    candidates = s.users.select(F.col("id").alias("position"), F.col("id").alias("user_id"), F.lit("peer").alias("role"))
    candidates = candidates.unionByName(candidates)
    return messaging.contacts(candidates, messaging.direct_partners(s.conversations, s.members, USER), s.users, USER, " 1").select("user_id", "full_name")


@_query("last_per_conv", f"{_SHAPES} SELECT conversation_id, max(id) AS id, arg_max(sender_id, id) AS sender_id FROM messages GROUP BY conversation_id")
def last_per_conv(spark: SparkSession, d: str) -> DataFrame:
    return messaging.last_messages(_shapes(spark, d).messages, ["id", "sender_id"]).select("conversation_id", "id", F.col("sender_id").cast("int"))


@_query("newest_page_reversed", f"{_SHAPES} SELECT id FROM messages WHERE conversation_id = 3 ORDER BY id DESC LIMIT 2 OFFSET 2")
def newest_page_reversed(spark: SparkSession, d: str) -> DataFrame:
    return messaging.newest_page(_shapes(spark, d).messages, 3, 1, 2).select("id")


@_query("reply_preview", f"{_SHAPES} SELECT m.id, p.id AS parent_id, p.sender_id AS parent_sender FROM messages m LEFT JOIN messages p ON p.id = m.replied_to_msg_id")
def reply_preview(spark: SparkSession, d: str) -> DataFrame:
    m = messaging.with_replies(_shapes(spark, d).messages, ["sender_id"])
    return m.select("id", F.col("replied_to.id").alias("parent_id"), F.col("replied_to.sender_id").cast("int").alias("parent_sender"))


@_query("soft_delete", f"{_SHAPES} SELECT id, deleted_for_everyone OR (id = 302 AND sender_id = 1) AS deleted_for_everyone, CASE WHEN id = 302 AND sender_id = 1 THEN NULL ELSE length(content) END AS n FROM messages")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    return messaging.soft_deleted(_shapes(spark, d).messages, 302, USER).select("id", "deleted_for_everyone", F.length("content").cast("long").alias("n"))


def _reactions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("event_id") % 50).alias("message_id"), "user_id", F.col("event_type").alias("emoji"), F.col("event_id").alias("created_at"))


_REACTED = "SELECT event_id % 50 AS message_id, event_type AS emoji, count(*) AS n, bool_or(user_id = 7) AS reacted_by_me, min(event_id) AS first_at FROM events GROUP BY ALL"


@_query("reaction_summary", f"SELECT message_id, emoji, n, reacted_by_me, row_number() OVER (PARTITION BY message_id ORDER BY first_at, emoji) AS rank FROM ({_REACTED})")
def reaction_summary(spark: SparkSession, d: str) -> DataFrame:
    return messaging.reaction_summary(_reactions(spark, d), 7).select("message_id", "emoji", "n", "reacted_by_me", F.col("rank").cast("long"))


@_query("reaction_lists", f"SELECT message_id, string_agg(emoji || ':' || n, ' ' ORDER BY first_at, emoji) AS shown FROM ({_REACTED}) GROUP BY message_id")
def reaction_lists(spark: SparkSession, d: str) -> DataFrame:
    r = _reactions(spark, d)
    shown = messaging.with_reactions(r.select(F.col("message_id").alias("id")).distinct(), messaging.reaction_summary(r, 7))
    return shown.select(F.col("id").alias("message_id"), F.array_join(F.transform("reactions", lambda x: F.concat(x["emoji"], F.lit(":"), x["n"].cast("string"))), " ").alias("shown"))


@_query(
    "conversation_summaries",
    f"""{_SHAPES}, people AS (SELECT m.conversation_id, string_agg(u.full_name, ',' ORDER BY m.user_id) AS names, arg_min(u.avatar_url, CASE WHEN m.user_id != 1 THEN m.user_id END) AS face
          FROM members m LEFT JOIN users u ON u.id = m.user_id GROUP BY m.conversation_id)
        SELECT c.id, p.names, (SELECT max(id) FROM messages x WHERE x.conversation_id = c.id) AS last_id,
          CASE WHEN c.type = 'GROUP' THEN CASE WHEN c.course_id IS NOT NULL THEN 'course' || c.course_id ELSE c.avatar_url END ELSE p.face END AS avatar
        FROM convs c JOIN members m ON m.conversation_id = c.id AND m.user_id = 1 LEFT JOIN people p ON p.conversation_id = c.id""",
)
def conversation_summaries(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    found = messaging.summaries(s.conversations, s.members, s.messages, s.users, s.courses, USER)
    return found.select("id", F.array_join(F.col("participants.full_name"), ",").alias("names"), F.col("last_message.id").alias("last_id"), "avatar")


@_query("aes_roundtrip", "SELECT doc_id, sha256(text) AS digest, 12 + strlen(text) + 16 AS n_bytes, true AS broken_is_null FROM documents")
def aes_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    key = F.lit("MDEyMzQ1Njc4OTAxMjM0NTY3ODkwMTIzNDU2Nzg5MDE=")
    sealed = table(spark, d, "documents").select("doc_id", crypto.encrypted(F.col("text"), key).alias("content"))
    opened = crypto.decrypted(F.col("content"), key)
    broken = crypto.decrypted(F.concat(F.lit("A"), F.substring("content", 2, 1 << 30)), F.lit("MDEyMzQ1Njc4OTAxMjM0NTY3ODkwMTIzNDU2Nzg5MDI="))
    return sealed.select("doc_id", F.sha2(opened, 256).alias("digest"), F.octet_length(F.unbase64("content")).cast("long").alias("n_bytes"), broken.isNull().alias("broken_is_null"))


@_query("semi_exists", "SELECT c_custkey FROM customer c WHERE c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("big")).distinct()
    return table(spark, d, "customer").join(big, "c_custkey", "left").where((F.col("c_mktsegment") == "BUILDING") | F.coalesce("big", F.lit(False))).select("c_custkey")


@_query("like_literal", "SELECT p_partkey FROM part WHERE p_type LIKE '%E%' AND p_size > 10")
def like_literal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_type").like("%E%") & (F.col("p_size") > 10)).select("p_partkey")


# --- calendars -----------------------------------------------------------------------

_DAY = "2024-01-15"


def _calendar(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.to_date("ts").alias("event_date"),
        F.when(F.col("event_id") % 5 == 0, "9h").otherwise(F.date_format("ts", "HH:mm")).alias("start_time"),
        F.date_format("ts", "HH:mm").alias("end_time"),
        F.concat_ws("; ", "event_type", "props").alias("title"),
        F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.concat(F.col("event_type"), F.lit(",\r\n\\x"))).alias("description"),
    )


def _in_range(kind: str, spark: SparkSession, d: str) -> DataFrame:
    return calendar.events_in(_calendar(spark, d), None, kind, F.lit(_DAY).cast("date")).select("id")


for _kind, _sql in {
    "day": "CAST(ts AS DATE) = DATE '2024-01-15'",
    "week": "date_trunc('week', ts) = date_trunc('week', DATE '2024-01-15')",
    "month": "date_trunc('month', ts) = DATE '2024-01-01'",
    "year": "date_trunc('year', ts) = DATE '2024-01-01'",
}.items():
    _ALL[f"cal_{_kind}"] = (partial(_in_range, _kind), f"SELECT event_id AS id FROM events WHERE {_sql}")


@_query(
    "cal_tagged",
    """SELECT 'events' AS part, count(*) AS n FROM events WHERE user_id = 7 AND date_trunc('week', ts) = DATE '2024-01-15'
       UNION ALL SELECT 'today', count(*) FROM events WHERE user_id = 7 AND CAST(ts AS DATE) = DATE '2024-01-15'
       UNION ALL SELECT 'tomorrow', count(*) FROM events WHERE user_id = 7 AND CAST(ts AS DATE) = DATE '2024-01-16'""",
)
def cal_tagged(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit(_DAY).cast("date")
    found = calendar.tagged(_calendar(spark, d), 7, "WEEK", day, day).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parts = spark.createDataFrame([("events",), ("today",), ("tomorrow",)], "part string")
    return parts.join(found, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"))


_ICS = r"""SELECT event_id AS id, 'BEGIN:VEVENT' || chr(10) || 'UID:' || event_id || '@cal.example' || chr(10) || 'DTSTAMP:20240101T000000Z' || chr(10)
  || 'DTSTART:' || strftime(ts, '%Y%m%dT') || CASE WHEN event_id % 5 = 0 THEN '090000' ELSE strftime(ts, '%H%M00') END || chr(10)
  || 'DTEND:' || strftime(ts, '%Y%m%dT%H%M00') || chr(10)
  || 'SUMMARY:' || replace(replace(replace(event_type || '; ' || props, '\', '\\'), ';', '\;'), ',', '\,') || chr(10)
  || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'DESCRIPTION:' || event_type || '\,' || '\n' || '\\x' || chr(10) END || 'END:VEVENT' AS lines
  FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15'"""


@_query("ics_lines", _ICS)
def ics_lines(spark: SparkSession, d: str) -> DataFrame:
    found = calendar.event_lines(_calendar(spark, d), None, F.lit(_DAY).cast("date"), "20240101T000000", "cal.example")
    return found.select("id", F.array_join("lines", "\n").alias("lines"))


@_query("event_responses", "SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d') AS event_date, event_id % 3 = 0 AS blank FROM events")
def event_responses(spark: SparkSession, d: str) -> DataFrame:
    return calendar.response(_calendar(spark, d)).select("id", "event_date", F.col("description").isNull().alias("blank"))


@_query("event_defaults", "SELECT doc_id, '' AS title, '2024-01-15' AS event_date, '09:00' AS start_time, '18:00' AS end_time, lang AS color FROM documents")
def event_defaults(spark: SparkSession, d: str) -> DataFrame:
    n = F.lit(None).cast("string")
    asked = table(spark, d, "documents").select("doc_id", n.alias("title"), n.cast("date").alias("event_date"), F.lit(" ").alias("start_time"), n.alias("end_time"), F.col("lang").alias("color"), n.alias("description"))
    return calendar.with_defaults(asked, F.lit(_DAY).cast("date")).select("doc_id", "title", F.col("event_date").cast("string"), "start_time", "end_time", "color")


@_query("utc_stamps", """SELECT event_id, CASE WHEN epoch_us(ts) % 60000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%MZ')
     WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
     WHEN epoch_us(ts) % 1000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z'
     ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS stamp FROM events""")
def utc_stamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", times.utc_text(F.col("ts")).alias("stamp"))


# --- access --------------------------------------------------------------------------


@_query("authority_cross", "SELECT r_name || ':' || p_type AS name FROM region CROSS JOIN (SELECT DISTINCT p_type FROM part)")
def authority_cross(spark: SparkSession, d: str) -> DataFrame:
    return access.generated(table(spark, d, "region").select(F.col("r_name").alias("resource")), table(spark, d, "part").select(F.col("p_type").alias("action")))


@_query("authority_missing", "SELECT DISTINCT p_name AS name FROM part EXCEPT SELECT p_type FROM part")
def authority_missing(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return access.missing(part.select(F.col("p_name").alias("name")), part.select(F.col("p_type").alias("name")))


@_query("authority_union", "SELECT p_type AS name FROM part UNION SELECT p_brand FROM part UNION SELECT r_name FROM region")
def authority_union(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return access.union(part.select(F.col("p_type").alias("name")), part.select(F.col("p_brand").alias("name")), table(spark, d, "region").select(F.col("r_name").alias("name")))


@_query("authority_named", "SELECT n_nationkey FROM nation WHERE n_name IN ('FRANCE', 'GERMANY', 'NATION_1', 'NATION_2')")
def authority_named(spark: SparkSession, d: str) -> DataFrame:
    return access.of_names(table(spark, d, "nation").withColumnRenamed("n_name", "name"), ["FRANCE", "GERMANY", "NATION_1", "NATION_2"]).select("n_nationkey")


@_query(
    "m2m_sets",
    """SELECT owner_id, array_to_string(list(name ORDER BY name), ',') AS names FROM (SELECT DISTINCT p_partkey AS owner_id, s_name AS name
       FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey) GROUP BY owner_id""",
)
def m2m_sets(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    pairs = access.through(part, table(spark, d, "lineitem").select("l_partkey", "l_suppkey"), supplier, "l_partkey", "l_suppkey")
    return access.name_sets(pairs).select("owner_id", F.array_join("names", ",").alias("names"))


@_query(
    "effective_authorities",
    """SELECT owner_id, count(DISTINCT name) AS n FROM (SELECT c_custkey AS owner_id, c_mktsegment AS name FROM customer
       UNION ALL SELECT o_custkey, o_orderpriority FROM orders) GROUP BY owner_id""",
)
def effective_authorities(spark: SparkSession, d: str) -> DataFrame:
    active = table(spark, d, "customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_mktsegment").alias("name"))
    subs = table(spark, d, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("name"))
    return access.effective(active, subs).select("owner_id", F.size("authorities").cast("long").alias("n"))


@_query("readable_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'P'")
def readable_rows(spark: SparkSession, d: str) -> DataFrame:
    defs = spark.createDataFrame([("F", True, True), ("O", True, None), ("P", True, False)], "key string, active boolean, public_get boolean")
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("entity_key"))
    return access.readable_rows(rows, defs, F.array(F.lit("P:read"))).select("o_orderkey")


@_query("member_rows", f"{_SHAPES} SELECT id FROM messages m WHERE EXISTS (SELECT 1 FROM members c WHERE c.conversation_id = m.conversation_id AND c.user_id = 3)")
def member_rows(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    return access.member_rows(s.messages, s.members, 3).select("id")


@_query("owned_rows", "SELECT event_id FROM events WHERE user_id = 7")
def owned_rows(spark: SparkSession, d: str) -> DataFrame:
    return access.owned(table(spark, d, "events"), 7).select("event_id")


@_query(
    "active_roles",
    """SELECT c_custkey AS id, coalesce(max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority END), min(o_orderpriority), 'none') AS role
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey""",
)
def active_roles(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("1-URGENT").alias("last_role"))
    roles = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("role"))
    return access.active_roles(users, roles, F.col("role") != "5-LOW", "none")


@_query("linked_accounts", "SELECT c_name AS email, CASE WHEN c_custkey % 2 = 0 THEN 's' || c_custkey END AS google_id FROM customer UNION ALL SELECT 'new', 's0'")
def linked_accounts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    logins = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("email"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("subject"))
    logins = logins.unionByName(spark.createDataFrame([("new", "s0")], "email string, subject string"))
    return access.linked_accounts(c.select(F.col("c_name").alias("email"), F.lit(None).cast("string").alias("google_id")), logins, "google").select("email", "google_id")


@_query("json_titles", "SELECT doc_id FROM documents WHERE source ILIKE '%rc1%' OR lang ILIKE '%rc1%'")
def json_titles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(text.json_like(F.create_map("lang", "source"), "rc1")).select("doc_id")


@_query("claims_read", "SELECT event_id, event_type AS role, 2 AS n FROM events")
def claims_read(spark: SparkSession, d: str) -> DataFrame:
    claims = F.to_json(F.struct(F.struct(F.col("event_type").alias("name")).alias("role"), F.array(F.lit("a:read"), F.lit("b:read")).alias("authorities")))
    return table(spark, d, "events").select("event_id", text.role_name(claims).alias("role"), F.size(text.claim_authorities(claims)).alias("n"))


@_query("key_changes", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 0")
def key_changes(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("key"))
    return state.key_changes(old, old.withColumn("key", F.when(F.col("id") % 7 == 0, "new").otherwise(F.col("key")))).select("id")


# --- state and life cycle ------------------------------------------------------------


@_query("merge_state", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -1 - o_orderkey, 'N' FROM orders WHERE o_orderstatus = 'P'")
def merge_state(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    now = orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("X").alias("status"))
    changes = urgent.unionByName(orders.where("o_orderstatus = 'P'").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("status")))
    return state.upserted(now, changes, ["o_orderkey"])


@_query("replace_state", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey <> 7 UNION ALL SELECT o_orderkey, 7 FROM orders WHERE o_orderstatus = 'P'")
def replace_state(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return state.replaced(orders.select("o_orderkey", "o_custkey"), F.col("o_custkey") == 7, orders.where("o_orderstatus = 'P'").select("o_orderkey", F.lit(7).cast("long").alias("o_custkey")))


@_query("ensure_state", "SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part")
def ensure_state(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return state.ensured(part.select(F.col("p_brand").alias("name")).distinct(), part.select(F.col("p_type").alias("name")), ["name"])


@_query("delete_state", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def delete_state(spark: SparkSession, d: str) -> DataFrame:
    return state.deleted(table(spark, d, "orders"), F.col("o_orderstatus") == "F").select("o_orderkey")


@_query("cascade_delete", "SELECT DISTINCT event_type || ':' || a AS name FROM events, (VALUES ('create'), ('read'), ('update'), ('delete')) v(a) WHERE event_type <> 'click'")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "events").select(F.col("event_type").alias("resource")).distinct()
    actions = spark.createDataFrame([("create",), ("read",), ("update",), ("delete",)], "action string")
    return state.cascaded(kinds.withColumnRenamed("resource", "key"), access.generated(kinds, actions), "click")[1]


@_query("expired_tokens", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00'")
def expired_tokens(spark: SparkSession, d: str) -> DataFrame:
    return state.expired(table(spark, d, "events"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), "ts").select("event_id")


@_query("live_rows", "SELECT event_id FROM events WHERE ts + INTERVAL 21600 SECOND > TIMESTAMP '2024-01-10 00:00:00'")
def live_rows(spark: SparkSession, d: str) -> DataFrame:
    return state.live(table(spark, d, "events"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), 21_600, "ts").select("event_id")


@_query("gc_files", "SELECT event_id FROM events WHERE user_id % 2 = 1 AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR")
def gc_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "events").select("event_id", (F.col("user_id") % 2 == 0).alias("is_linked"), F.col("ts").alias("created_at"))
    return state.garbage(files, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id")


@_query("evict_oldest", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS device_id FROM events GROUP BY user_id HAVING count(*) >= 5")
def evict_oldest(spark: SparkSession, d: str) -> DataFrame:
    devices = table(spark, d, "events").select("user_id", F.col("event_id").alias("device_id"), F.col("ts").alias("created_at"))
    return state.evicted(devices, 5).select("user_id", "device_id")


@_query("index_names", "SELECT name, change FROM (VALUES ('own', 'replace'), ('old', 'drop'), ('entity_idx_' || substr(translate(to_base64(unhex(sha256('a:-1|b:null'))), '+/=', '-_'), 1, 10), 'create')) v(name, change)")
def index_names(spark: SparkSession, d: str) -> DataFrame:
    schema = "name string, fields array<struct<path:string,direction:int>>"
    desired = state.index_names(spark.createDataFrame([("own", [("a", 1)]), (None, [("A", -1), ("b", None)])], schema))
    existing = spark.createDataFrame([("own",), ("old",), ("_id_",)], "name string")
    return state.index_changes(desired, existing)


@_query(
    "index_specs",
    """SELECT * FROM (VALUES ('own', 'data.name', 1, 1, TRUE, FALSE), ('own', 'createdAt', -1, 2, TRUE, FALSE), ('own', 'data.size', 1, 3, TRUE, FALSE),
       ('entity_idx_' || substr(translate(to_base64(unhex(sha256(':null|data.at:0'))), '+/=', '-_'), 1, 10), 'data.At', 1, 1, FALSE, TRUE)) v(name, path, direction, place, is_unique, is_sparse)""",
)
def index_specs(spark: SparkSession, d: str) -> DataFrame:
    schema = "name string, fields array<struct<path:string,direction:int>>, unique boolean, sparse boolean"
    rows = [("own", [("name", 1), ("createdAt", -1), (" ", -1), ("data.size", None)], True, None), (" ", [(None, None), ("data.At", 0)], False, True), ("none", [], True, True)]
    made = state.index_specs(spark.createDataFrame(rows, schema))
    keys = made.select("name", F.posexplode("keys").alias("at", "k"), F.col("unique").alias("is_unique"), F.col("sparse").alias("is_sparse"))
    return keys.select("name", "k.path", "k.direction", (F.col("at") + 1).alias("place"), "is_unique", "is_sparse")


@_query("short_digests", "SELECT r_name, substr(translate(to_base64(unhex(sha256(r_name))), '+/=', '-_'), 1, 10) AS digest FROM region")
def short_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select("r_name", crypto.short_digest(F.col("r_name")).alias("digest"))


@_query("text_functions", "SELECT p_partkey, lower(p_name) AS low, 'Dear ' || p_brand || '!' AS filled, '7' AS user_id, p_type AS kept FROM part")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(
        "p_partkey",
        F.lower(text.trimmed(F.concat(F.lit("\t "), F.col("p_name"), F.lit(" \n")))).alias("low"),
        text.filled(F.lit("Dear ${who}!"), {"who": F.col("p_brand")}).alias("filled"),
        text.query_parameter(F.lit("ws://h/chat?x=1&userId=7"), "userId").alias("user_id"),
        text.or_default(F.col("p_type"), "none").alias("kept"),
    )


@_query("by_key", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")
def by_key(spark: SparkSession, d: str) -> DataFrame:
    return tables.by_key(table(spark, d, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey")


@_query("by_nested_key", "SELECT o_orderkey AS _id FROM orders WHERE o_orderkey = 9")
def by_nested_key(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), F.struct(F.col("o_orderkey").alias("number")).alias("data"))
    return tables.by_key(records, "data.number", 9).select("_id")


@_query("row_exists", "SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 1e12")
def row_exists(spark: SparkSession, d: str) -> DataFrame:
    return tables.exists(table(spark, d, "orders"), F.col("o_totalprice") > 1e12)


@_query("byte_ranges", "SELECT doc_id, substr(source, 2, 3) AS middle, substr(source, 3) AS tail, right(source, 2) AS last FROM documents")
def byte_ranges(spark: SparkSession, d: str) -> DataFrame:
    cut = lambda h: tables.byte_range(F.col("source").cast("binary"), h).cast("string")
    return table(spark, d, "documents").select("doc_id", cut("bytes=1-3").alias("middle"), cut("bytes=2-").alias("tail"), cut("bytes=-2").alias("last"))


@_query("insert_state", "SELECT n_nationkey AS id, n_name AS name, NULL AS note FROM nation UNION ALL SELECT r_regionkey + 100, r_name, 'new' FROM region")
def insert_state(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("note"))
    rows = table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name"), F.lit("new").alias("note"))
    return state.inserted(now, rows).select(F.col("id").cast("long"), "name", "note")


@_query("seeded_state", "SELECT r_name AS name FROM region UNION SELECT n_name FROM nation UNION SELECT r_name FROM region")
def seeded_state(spark: SparkSession, d: str) -> DataFrame:
    regions, nations = table(spark, d, "region").select(F.col("r_name").alias("name")), table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return sinks.seeded(regions, (regions, ["name"]), (nations, ["name"]), (regions, ["name"]))


@_query("audited_rows", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '2023-05-01' ELSE '2024-01-15' END AS created, '2024-01-15' AS updated, CASE WHEN o_orderstatus = 'F' THEN 'clerk' ELSE 'me' END AS by FROM orders")
def audited_rows(spark: SparkSession, d: str) -> DataFrame:
    old = F.col("o_orderstatus") == "F"
    rows = table(spark, d, "orders").select("o_orderkey", F.when(old, F.lit("2023-05-01").cast("date")).alias("createdAt"), F.lit(None).cast("date").alias("updatedAt"), F.when(old, "clerk").alias("createdBy"))
    done = state.synced(state.audited(rows, F.lit(_DAY).cast("date"), "me"), F.lit(_DAY).cast("date"))
    return done.select("o_orderkey", F.col("createdAt").cast("string").alias("created"), F.col("updatedAt").cast("string").alias("updated"), F.col("createdBy").alias("by"))


@_query("uploads_completed", "SELECT p_name AS file_name, p_partkey, CASE WHEN p_size > 20 AND EXISTS (SELECT 1 FROM part q WHERE q.p_name = part.p_name AND q.p_brand = 'Brand#1') THEN 'COMPLETED' WHEN p_size > 20 THEN 'PENDING' ELSE 'FAILED' END AS status FROM part")
def uploads_completed(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    uploads = part.select(F.col("p_name").alias("file_name"), "p_partkey", F.when(F.col("p_size") > 20, "PENDING").otherwise("FAILED").alias("status"))
    return state.completed(uploads, part.where("p_brand = 'Brand#1'").select(F.col("p_name").alias("file_name")))


@_query(
    "media_access",
    f"""{_SHAPES} SELECT DISTINCT 'f' || m.id AS file_name FROM messages m JOIN members c USING (conversation_id) WHERE c.user_id = 3 AND m.deleted_for_everyone IS FALSE""",
)
def media_access(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    name = F.concat(F.lit("f"), F.col("id").cast("string"))
    return messaging.media_access(s.messages.select(name.alias("file_name")).distinct(), s.messages.withColumn("media_url", F.concat(F.lit("https://files/x/"), name)), s.members, 3)


@_query("usable_users", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND NOT (c_mktsegment = 'BUILDING')")
def usable_users(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("enabled"), (F.col("c_mktsegment") == "BUILDING").alias("blocked"))
    return access.usable(users).select("c_custkey")


@_query(
    "token_claims",
    """SELECT CAST(c_custkey AS VARCHAR) AS sub, c_mktsegment AS role, coalesce(a.names, '') AS authorities, 15 AS minutes
       FROM customer LEFT JOIN (SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS names FROM orders GROUP BY o_custkey) a ON o_custkey = c_custkey""",
)
def token_claims(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("role"))
    held = access.effective(table(spark, d, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("name")), table(spark, d, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("name")))
    told = access.claims(users, held, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 15)
    return told.select("sub", "role", F.array_join("authorities", ",").alias("authorities"), F.timestamp_diff("MINUTE", "iat", "exp").cast("int").alias("minutes"))


@_query("without_space", "SELECT p_partkey, replace(p_name, ' ', '') AS name FROM part")
def without_space(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.without_space(F.col("p_name")).alias("name"))


@_query("full_records", "SELECT o_orderkey AS _id, o_orderstatus AS status FROM orders")
def full_records(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_orderstatus").alias("status"), F.lit("orders").alias("entity"), F.lit(1).alias("createdBy"))
    return projection.full(records)


@_query("gated_filters", "SELECT event_id FROM events WHERE event_type = 'click'")
def gated_filters(spark: SparkSession, d: str) -> DataFrame:
    """Without the permission to search, text predicates are left out; other filters hold."""
    plan = language.plan({"event_type_eq": "click", "event_type_contains": "view"}, Definition("events", allow_filters=True), prefix="")
    return plans.filtered(table(spark, d, "events"), plan).select("event_id")


@_query("closed_filters", "SELECT event_id FROM events")
def closed_filters(spark: SparkSession, d: str) -> DataFrame:
    """Without the permission to filter, nothing is filtered."""
    plan = language.plan({"event_type_eq": "click"}, Definition("events", allow_search=True), prefix="")
    return plans.filtered(table(spark, d, "events"), plan).select("event_id")


@_query("untranslated_field", "SELECT doc_id AS _id FROM documents WHERE source = 'src1'")
def untranslated_field(spark: SparkSession, d: str) -> DataFrame:
    """A field that avoids translation is read plainly, whatever the language."""
    definition = Definition("docs", (Field("title", avoid_translate=True),), allow_filters=True)
    records = table(spark, d, "documents").select(F.col("doc_id").alias("_id"), F.struct(F.col("source").alias("title")).alias("data"))
    return plans.filtered(records, language.plan({"title_eq": "src1", "language": "de"}, definition)).select("_id")


@_query("default_sort", "SELECT o_orderkey AS _id FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 15")
def default_sort(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), F.struct(F.col("o_totalprice").alias("total")).alias("data"))
    definition = Definition("orders", (Field("total"),), allow_sort=True, default_sort=("total", "DESC"))
    return plans.paged(records, language.plan({"take": "15"}, definition), "_id").select("_id")


@_query(
    "lang_sort_two_keys",
    "SELECT doc_id AS _id FROM documents ORDER BY CASE WHEN lang = 'de' THEN source END NULLS FIRST, lang NULLS FIRST, doc_id LIMIT 40 OFFSET 3",
)
def lang_sort_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """By the translated title, then by the plain one."""
    docs = table(spark, d, "documents")
    fields = F.struct(F.create_map("lang", "source").alias("title"))
    records = docs.select(F.col("doc_id").alias("_id"), fields.alias("data"), "lang")
    plan = language.plan({"sort.key": "title", "language": "de", "offset": "3", "take": "40"}, _TRANSLATED)
    translated, _ = plan.order
    # a map has no order of its own, so the plain key is the column beside it
    return plans.paged(records, language.Plan(order=(translated, ("lang", False)), offset=plan.offset, limit=plan.limit), "_id").select("_id")


@_query("calendar_order", "SELECT event_id AS id, row_number() OVER (ORDER BY CAST(ts AS DATE), CASE WHEN event_id % 5 = 0 THEN '9h' ELSE strftime(ts, '%H:%M') END, event_id) AS place FROM events WHERE user_id = 7")
def calendar_order(spark: SparkSession, d: str) -> DataFrame:
    own = access.owned(_calendar(spark, d), 7)
    listed = own.agg(F.array_sort(F.collect_list(F.struct("event_date", "start_time", "id"))).alias("e"))
    return listed.select(F.posexplode("e").alias("p", "x")).select("x.id", (F.col("p") + 1).cast("long").alias("place"))


@_query(
    "logins_revoke",
    """WITH ranked AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS held FROM events)
       SELECT user_id, event_id AS device_id FROM ranked WHERE NOT (held >= 5 AND n = 1)""",
)
def logins_revoke(spark: SparkSession, d: str) -> DataFrame:
    """A login at the limit evicts the oldest device, and its refresh tokens with it."""
    devices = table(spark, d, "events").select("user_id", F.col("event_id").alias("device_id"), F.col("ts").alias("created_at"))
    return state.revoked(devices.select("user_id", "device_id"), state.evicted(devices, 5)).select("user_id", "device_id")


# --- streams: run over what the tables hold, then compared with SQL over the same rows --

_ALL["stream_fanout"] = (
    lambda spark, d: runs.fan_out_run(spark, d, _shapes(spark, d).members),
    f"{_SHAPES} SELECT c.user_id AS recipient_id, count(*) AS n FROM messages m JOIN members c ON c.conversation_id = m.conversation_id GROUP BY c.user_id",
)
_ALL["stream_calls"] = (
    lambda spark, d: runs.call_run(spark, d, _shapes(spark, d).members),
    f"{_SHAPES} SELECT c.user_id AS recipient_id, count(*) AS n FROM messages m JOIN members c ON c.conversation_id = m.conversation_id AND c.user_id != m.sender_id WHERE m.id % 2 = 1 GROUP BY c.user_id",
)
_ALL["stream_unread"] = (
    lambda spark, d: runs.unread_run(spark, d, _shapes(spark, d)),
    f"""{_SHAPES}, counted AS (
      SELECT c.user_id, m.conversation_id, count(*) FILTER (WHERE NOT m.deleted_for_everyone AND m.id > coalesce(r.last_message_id, 0)) AS unread
      FROM members c JOIN messages m ON m.conversation_id = c.conversation_id AND m.sender_id <> c.user_id
      LEFT JOIN receipts r ON r.conversation_id = c.conversation_id AND r.user_id = c.user_id GROUP BY ALL
    ), totals AS (SELECT user_id, CAST(sum(unread) AS BIGINT) AS total FROM counted GROUP BY user_id)
    SELECT t.user_id, t.total, p.conversation_id, p.unread FROM totals t LEFT JOIN (FROM counted WHERE unread > 0) p ON p.user_id = t.user_id""",
)
_TOGGLED = """WITH RECURSIVE e AS (SELECT event_id % 50 AS message_id, user_id, event_type AS emoji, row_number() OVER (PARTITION BY event_id % 50, user_id ORDER BY event_id) AS n FROM events),
  f AS (SELECT message_id, user_id, n, emoji AS now FROM e WHERE n = 1
    UNION ALL SELECT e.message_id, e.user_id, e.n, CASE WHEN f.now = e.emoji THEN NULL ELSE e.emoji END FROM f JOIN e ON e.message_id = f.message_id AND e.user_id = f.user_id AND e.n = f.n + 1)
  SELECT message_id, user_id, arg_max_null(now, n) AS emoji FROM f GROUP BY ALL HAVING arg_max_null(now, n) IS NOT NULL"""
_ALL["toggle_fold"] = (lambda spark, d: frames.toggled(_reactions(spark, d), F.col("created_at")), _TOGGLED)
_ALL["stream_toggle"] = (lambda spark, d: runs.toggle_run(spark, d), _TOGGLED)


@_query("session_registry", "SELECT user_id, arg_max(event_id, event_id) AS session FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'click'")
def session_registry(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "click", "CLOSE").otherwise("OPEN").alias("kind"), F.col("event_id").alias("session"))
    return frames.sessions(e, F.col("session"))


_ALL["stream_sessions"] = (runs.session_run, _ALL["session_registry"][1])


@_query("session_overflow", "SELECT user_id AS recipient_id, CAST(sum(strlen(event_type || event_id) * 50) AS BIGINT) AS bytes FROM events GROUP BY user_id HAVING bytes > 20000")
def session_overflow(spark: SparkSession, d: str) -> DataFrame:
    """Users whose frames outgrow a buffer of 20,000 bytes."""
    value = F.repeat(F.concat("event_type", F.col("event_id").cast("string")), F.lit(50))
    return frames.overflowing(table(spark, d, "events").select(F.col("user_id").alias("recipient_id"), value.alias("value")), 20_000)


@_query(
    "receipt_upsert",
    f"""{_SHAPES}, e AS (SELECT conversation_id, 1 AS user_id, arg_max_null(CASE WHEN id % 2 = 0 THEN id - 1 END, id) AS last_message_id, max(id) AS newest FROM messages GROUP BY conversation_id)
        SELECT conversation_id, coalesce(last_message_id, newest) AS last_message_id FROM e""",
)
def receipt_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d)
    events = s.messages.select("conversation_id", F.lit(1).cast("long").alias("user_id"), F.when(F.col("id") % 2 == 0, F.col("id") - 1).alias("last_message_id"), F.col("id").alias("o"))
    newest = s.messages.groupBy("conversation_id").agg(F.max("id").alias("newest_id"))
    return frames.receipts(s.receipts, events, newest, F.col("o")).select("conversation_id", "last_message_id")


_ALL["stream_receipts"] = (
    lambda spark, d: runs.receipt_run(spark, d, _shapes(spark, d).messages.groupBy("conversation_id").agg(F.max("id").alias("newest_id"))),
    _ALL["receipt_upsert"][1],
)


@_query(
    "personal_reactions",
    f"""{_SHAPES}, r AS (SELECT event_id % 100 AS conversation_id, event_id % 50 AS message_id, user_id % 5 AS user_id, event_type AS emoji FROM events),
        n AS (SELECT conversation_id, message_id, emoji, count(*) AS n FROM r GROUP BY ALL)
        SELECT n.conversation_id, m.user_id AS recipient_id, n.message_id, n.emoji, n.n, EXISTS (SELECT 1 FROM r WHERE r.message_id = n.message_id AND r.emoji = n.emoji AND r.user_id = m.user_id) AS reacted_by_me
        FROM n JOIN members m ON m.conversation_id = n.conversation_id""",
)
def personal_reactions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    r = e.select((F.col("event_id") % 100).alias("conversation_id"), (F.col("event_id") % 50).alias("message_id"), (F.col("user_id") % 5).alias("user_id"), F.col("event_type").alias("emoji"))
    return frames.personal(r, _shapes(spark, d).members).select("conversation_id", "recipient_id", "message_id", "emoji", "n", "reacted_by_me")
