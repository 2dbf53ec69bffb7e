"""The license scan against a run of every rule without keywords, and each alternative of every rule."""

import itertools
import random
import re
import re._parser as parser

from millrace.llm import license_rules, licenses
from tests.conftest import DATA

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _expanded(pattern):
    """Every text of a rule's expression; of a range of characters the first, of a repetition the shortest."""

    def some(items):
        return ["".join(x) for x in itertools.product(*[one(*i) for i in items])]

    def one(kind, value):
        match str(kind):
            case "LITERAL":
                return [chr(value)]
            case "IN":
                return ["w"] if str(value[0][0]) == "NEGATE" else [chr(v if str(k) == "LITERAL" else v[0]) for k, v in value]
            case "BRANCH":
                return [x for b in value[1] for x in some(b)]
            case "SUBPATTERN":
                return some(value[3])
            case "MAX_REPEAT":
                low, high, inner = value
                assert high == 1 or len(parser.SubPattern(inner.state, list(inner))) >= 1
                return [""] * (low == 0) + [x * max(1, low) for x in some(inner)]
            case "NOT_LITERAL":
                return ["w"]
            case "ASSERT":
                return [""]
        raise AssertionError(kind)

    # what may stand before "under" never holds the keyword; its shortest form stands for all
    return sorted(set(some(parser.parse(pattern.replace(license_rules._U, "under ")))))


def plain(text):
    """All detections of all rules by rank, each kept unless a kept one overlaps it."""
    words = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", (text or "").translate(LOW)).strip(" ") + " "
    hits = []
    for r in licenses.rules():
        for m in re.finditer(r["re"], words):
            s = words[: m.start(1)].count(" ") - 1
            e = s + m.group(1).count(" ") + 1
            hits.append((r["priority"], s - e, s, r["id"], e, r["label"], r["confidence"]))
    kept = []
    for h in sorted(hits):
        if not any(k[2] < h[4] and h[2] < k[4] for k in kept):
            kept.append(h)
    return sorted((s, e, label, p, c) for p, _, s, _, e, label, c in kept)


def _scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r["doc_id"]: [tuple(x) for x in r["detections"]] for r in licenses.scan(df).collect()}


def test_rules_are_many_and_bounded():
    assert len(licenses.rules()) > 300
    words = licenses.keywords()
    assert not [(a, b) for a in words for b in words if a != b and b.startswith(a)]
    assert all(any(f" {k}" in f" {phrase}" for k in words) for phrase, _ in licenses.BASE)


def test_every_alternative_holds_its_keyword():
    lost = [(r["label"], text) for r in licenses.rules() for text in _expanded(r["re"][2:-6]) if f" {r['kw']}" not in f" {text}"]
    assert lost == []


def test_every_rule_finds_its_texts(spark):
    texts = [random.Random(i).choice(_expanded(r["re"][2:-6])).title() for i, r in enumerate(licenses.rules())]
    got = _scanned(spark, texts)
    assert all(got[i] for i in got) and got == {i: plain(t) for i, t in enumerate(texts)}


def test_scan_equals_all_rules_without_keywords(spark):
    rng = random.Random(5)
    pool = [random.Random(i).choice(_expanded(r["re"][2:-6])) for i, r in enumerate(licenses.rules())]
    filler = ["the", "license", "of", "mit", "under", "gpl", "2", "0", "x", "copyright", "(c)", "2020", "public-domain", "Été", "notice.\n"]
    texts = [" ".join(rng.choice(pool if rng.random() < 0.4 else filler) for _ in range(rng.randrange(1, 14))) for _ in range(250)]
    texts += [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert _scanned(spark, texts) == {i: plain(t) for i, t in enumerate(texts)}


def test_what_a_suppressed_detection_hid_comes_back(spark):
    hit = "struct<priority:int,less:int,s:int,id:int,e:int,label:string,confidence:double>"
    rows = [((5, -10, 0, 0, 10, "a", 0.1), (3, -2, 1, 1, 3, "b", 0.1), (1, -4, 8, 2, 12, "c", 0.1))]
    df = spark.createDataFrame([(list(r),) for r in rows], f"hits array<{hit}>")
    assert [x["label"] for x in df.select(licenses._resolved(df["hits"]).alias("r")).first()["r"]] == ["b", "c"]


def test_a_long_run_of_overlaps(spark):
    text = "mit license " * 4000
    assert _scanned(spark, [text])[0] == plain(text)


def test_licenses_behind_no_gate_word(spark):
    cases = {
        "Released under the GPL v2.": "gpl-2.0",
        "Distributed under the MIT.": "mit",
        "Permission is hereby granted, free of charge, to any person": "mit",
        "All Rights\nReserved": "proprietary",
        "The work comes AS-IS, without warranty": "warranty-disclaimer",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    got = {r["text"]: [x["label"] for x in r["detections"]] for r in licenses.scan(df).collect()}
    assert got == {t: [label] for t, label in cases.items()}


def test_names_without_their_old_keyword(spark):
    cases = {
        "Released under the FreeBSD license": "bsd-2-clause",
        "Licensed under Zero Clause BSD": "0bsd",
        "Licensed under Creative Commons Zero": "cc0-1.0",
        "Licensed under the Open Database License": "odbl-1.0",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    got = {r["text"]: [x["label"] for x in r["detections"]] for r in licenses.scan(df).collect()}
    assert got == {t: [label] for t, label in cases.items()}
