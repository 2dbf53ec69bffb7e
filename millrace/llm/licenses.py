"""License scans by ordered signature rules.

The rules (``license_rules``) are regular expressions over the words of a text. Each has a
keyword that begins a word in all that it can match: one search for the keywords leaves
most texts out, and in the others only rules whose keyword occurs are run. So the
keywords save work and change nothing; a test compares with a run of every rule.

Detections are ranked by priority, then length, then place, then the order of the rules.
In this order one is kept unless it lies inside a kept one or overlaps it. A detection
that a suppressed one would have suppressed is kept.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, free, let, table
from millrace.llm.license_rules import rules

#: A word: letters and digits of ASCII, and all beyond ASCII; as classes that are quickly told.
WORD = r"[\p{Alnum}\P{ASCII}]+"
BETWEEN = r"[\p{ASCII}&&[^\p{Alnum}]]+"

#: Phrases and labels: fixed values of the contract.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

_RULES = "array<struct<id:int,kw:string,re:string,label:string,priority:int,confidence:double>>"
#: A detection; ``less`` is its length below zero, so that an ascending sort is the ranking.
_HIT = "struct<priority:int,less:int,s:int,id:int,e:int,label:string,confidence:double>"
_FOUND = "array<struct<s:int,e:int,label:string,priority:int,confidence:double>>"


def keywords() -> list[str]:
    """The keywords of all rules; every phrase of ``BASE`` holds one of them at the beginning of a word."""
    return sorted({r["kw"] for r in rules()})


def keyword_pattern() -> str:
    """The keywords as one expression, by first letters, so that most words fail at once."""
    tree: dict[str, list[str]] = defaultdict(list)
    for k in keywords():
        tree[k[0]].append(k[1:])
    return "(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(tree.items())) + ")"


def _marked(words: Column, pattern: Column) -> Column:
    """A space-padded row of words with the first word of every match marked by \\x01 and the last by \\x02."""
    return F.regexp_replace(words, pattern, F.lit(" \x01$1\x02"))


def _spans(marked: Column) -> Column:
    """(s, e) of the marks, as word numbers, e exclusive."""

    def found(tokens: Column) -> Column:
        at = lambda test, shift: F.filter(F.transform(tokens, lambda t, i: F.when(test(t), i + shift)), lambda i: i.isNotNull())
        return F.arrays_zip(at(lambda t: t.startswith("\x01"), 0).alias("s"), at(lambda t: t.endswith("\x02"), 1).alias("e"))

    return let(F.split(F.trim(marked), " "), found)


def _clusters(hits: Column) -> Column:
    """Detections in groups that do not touch one another; ``hits`` are sorted by start."""
    empty = F.array().cast(f"array<{_HIT}>")
    start = F.struct(F.lit(-1).alias("end"), empty.alias("now"), F.array().cast(f"array<array<{_HIT}>>").alias("done"))

    def step(a: Column, x: Column) -> Column:
        closed = F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        apart = F.struct(x["e"].alias("end"), F.array(x).alias("now"), closed.alias("done"))
        return F.when(x["s"] >= a["end"], apart).otherwise(F.struct(F.greatest(a["end"], x["e"]).alias("end"), F.concat(a["now"], F.array(x)).alias("now"), a["done"].alias("done")))

    return F.aggregate(hits, start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def _kept(cluster: Column) -> Column:
    """The detections of one group that are not suppressed, best first."""

    def step(kept: Column, x: Column) -> Column:
        met = F.exists(kept, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
        return F.when(met, kept).otherwise(F.concat(kept, F.array(x)))

    ranked = F.aggregate(F.sort_array(cluster), F.array().cast(f"array<{_HIT}>"), step)
    return F.when(F.size(cluster) == 1, cluster).otherwise(ranked)


def _resolved(hits: Column) -> Column:
    """What is left of detections by priority and containment, by place."""
    by_place = F.transform(F.sort_array(F.transform(hits, lambda x: F.struct(x["s"], x.alias("x")))), lambda p: p["x"])
    left = F.flatten(F.transform(let(by_place, _clusters), _kept))
    return F.array_sort(F.transform(left, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["label"].alias("label"), x["priority"].alias("priority"), x["confidence"].alias("confidence"))))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words (long), base (array of s, e, label) and detections (array of s, e, label, priority, confidence).

    ``s`` and ``e`` number words from 0, ``e`` exclusive; both arrays are in order of
    place, and detections do not overlap. Null and empty texts have no words and no
    detections. Ties between rules go to the earlier rule. A text of any length is
    scanned whole, inside its row; time grows with its length, and beyond that only with
    the square of the longest unbroken run of overlapping detections. Nothing is
    shuffled; repeated rows stay. Columns of ``df`` named like a result are replaced.
    """
    new = ["n_words", "base", "detections"]
    df = free(df, new)
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # on the text as it is: a superset of what the normalised words would say
    gate = F.lower(value).rlike(f"(?:^|[^0-9a-z]){keyword_pattern()}")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(value), BETWEEN, " ")), F.lit(" "))

    def base(w: Column) -> Column:
        def one(phrase: str, label: str) -> Column:
            spans = F.when(F.contains(w, F.lit(f" {phrase} ")), _spans(_marked(w, F.lit(f" ({phrase})(?= )"))))
            return F.transform(F.coalesce(spans, F.array().cast("array<struct<s:int,e:int>>")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(label).alias("label")))

        return F.array_sort(F.concat(*[one(*rule) for rule in BASE]))

    def own(w: Column) -> Column:
        table_of_rules = F.from_json(F.lit(json.dumps(rules())), _RULES)
        held = F.array_distinct(F.regexp_extract_all(w, F.lit(f" ({keyword_pattern()})"), 1))
        tried = let(held, lambda h: F.filter(table_of_rules, lambda r: F.array_contains(h, r["kw"])))
        marked = F.transform(tried, lambda r: F.struct(r.alias("r"), _marked(w, r["re"]).alias("m")))
        hits = F.transform(
            F.filter(marked, lambda x: F.contains(x["m"], F.lit("\x01"))),
            lambda x: F.transform(
                _spans(x["m"]),
                lambda p: F.struct(
                    x["r"]["priority"].alias("priority"), (p["s"] - p["e"]).alias("less"), p["s"].alias("s"), x["r"]["id"].alias("id"),
                    p["e"].alias("e"), x["r"]["label"].alias("label"), x["r"]["confidence"].alias("confidence"),
                ),
            ),
        )
        return let(F.flatten(hits), _resolved)

    found = F.when(gate, let(words, lambda w: F.struct(base(w).alias("base"), own(w).alias("detections"))))
    # results travel in one struct through a generator, so that nothing is computed twice and no column needs a name of its own
    results = let(
        F.struct(F.regexp_count(value, F.lit(WORD)).cast("long").alias("n"), found.alias("f")),
        lambda x: F.struct(
            x["n"].alias("n_words"),
            F.coalesce(x["f"]["base"], F.array().cast("array<struct<s:int,e:int,label:string>>")).alias("base"),
            F.coalesce(x["f"]["detections"], F.array().cast(_FOUND)).alias("detections"),
        ),
    )
    return df.select("*", F.inline(F.array(results)))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan finds in every document; the score is the best confidence found."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    labels = F.col("base.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.s")).cast("long").alias("first_word"),
        F.array_max(F.col("base.s")).cast("long").alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, F.col("detections.label"))).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, F.lit(0.9)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.col("detections.confidence")), F.lit(0.0))).alias("score"),
    )
