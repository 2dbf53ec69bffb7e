"""Each rule of lines, urls and short items alone."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontam, linededup, quality, simhash, urlfilter
from tests.conftest import values
from tests.llm.test_brute import _smallest

LINES = {
    "A sentence with an end.": True,
    "A line without an end": False,
    "Il dit : « Non. »": True,
    "Il dit « bonjour »": True,
    "Next »": False,
    "Home.": False,
    "« Zurück.": False,
    "Contact us.": False,
    "Home » News » Sport.": False,
    "News / Sport / Football / Results.": False,
    "He went home / stayed there / slept and woke up at noon / ate with all of his friends.": True,
    "a | b | c | d.": False,
    "Stop!! Now!! Really!!": False,
    "### $$$ %%% words here.": False,
    "Read more.": False,
    "Alle Rechte vorbehalten.": False,
    "Tous droits réservés.": False,
    "Todos los derechos reservados.": False,
    "Mehr lesen.": False,
    "Page 3 of 7.": False,
    "The proclick here is no phrase.": True,
    "...": True,
    "": False,
}


def test_lines(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "line string")
    assert {r["line"]: r["p"] for r in df.select("line", quality.line_passes(F.col("line")).alias("p")).collect()} == LINES


@pytest.mark.parametrize("length", [30, 41, 60, 400])
def test_boilerplate_in_lines_of_any_length(spark, length):
    """One phrase for every 40 words fails a line, however long it is."""
    few = "word " * length + "read more."
    many = "word word word word click here " * (length // 4) + "end."
    df = spark.createDataFrame([(few,), (many,)], "line string")
    got = [r["p"] for r in df.select(quality.line_passes(F.col("line")).alias("p")).collect()]
    assert got == [length + 2 > quality.PHRASE_WORDS, False]


def test_short_lines_generalise(spark):
    docs = spark.createDataFrame([(i, f"Posted by user {name}\nown words {name} of {name} here {i}") for i, name in enumerate("abcdefghijkl")], "doc_id long, text string")
    rows = linededup.drop_recurring(docs).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in rows} == {i: int(i > 0) for i in range(12)}


def test_short_items():
    matcher = decontam.Matcher([(1, "cat sat"), (None, "q"), (3, "漢字"), (4, "cat sat"), (5, "")])
    found = lambda text: sorted((str(i), d, e) for i, d, e in matcher.find(decontam.normalised(text)))
    assert found("the cat, sat!") == [("1", 0, 11), ("4", 0, 11)]
    assert found("bobcat sat and cat sated") == []
    assert found("Q? quit") == [("None", 0, 1)] and found("quit iraq") == []
    assert found("以漢字書") == [("3", 0, 3)]


def test_matches_against_every_item(spark):
    """The query's operator against the edit distance of every item to every text."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7))) for _ in range(25)]
    items = [(i if i % 5 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))) for i in range(30)]
    texts = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(40))
        chars = list(rng.choice(items)[1])
        for _ in range(rng.randrange(3)):
            chars[rng.randrange(len(chars))] = rng.choice("xyz ")
        texts.append((i if i % 7 else None, text[:60] + " " + "".join(chars) + " " + text[60:]))

    def distance(item, text):
        k = int(len(item) * decontam.EDITS)
        if k == 0:
            return 0 if f" {item} " in f" {text} " else None
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row) if min(row) <= k else None

    docs, tests = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), str(j), d) for i, t in texts for j, item in items if (d := distance(decontam.normalised(item), decontam.normalised(t))) is not None)
    assert want and sorted((str(r["doc_id"]), str(r["item_id"]), r["distance"]) for r in decontam.matches(docs, tests).collect()) == want
    clean = [t for _, t in texts if all(distance(decontam.normalised(x), decontam.normalised(t)) is None for _, x in items)]
    assert sorted(r["text"] for r in decontam.decontaminated(docs, tests).collect()) == sorted(clean)


def test_url_trees_of_any_depth(spark):
    rng = random.Random(3)
    hosts = ["a.com", "b.com", "example.org", "x.example.org", "c.net", "org"]
    pages = []
    for i in range(900):
        depth = rng.randrange(0, 7)
        path = "".join("/" + rng.choice(["de", "fr", "es", "en", "1", "20240101", "x" * 45, "", "a", "b", "c"]) for _ in range(depth))
        pages.append((i % 850, rng.choice(["http://", "https://", "", "x"]) + rng.choice(hosts) + path + rng.choice(["", "?q=/de/", "#t", "/"])))
    pages += [(None, "http://deep.com" + "/de" + "/s" * 300), (7, None)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = urlfilter.judge(df)
    con = duckdb.connect()
    con.register("pages", df.toPandas().astype({"page_id": "Int64"}))
    cursor = con.execute(urlfilter.ORACLE_SQL)
    names = [c[0] for c in cursor.description]
    assert values([tuple(r) for r in got.collect()], got.columns) == values(cursor.fetchall(), names)
    assert {r["verdict"] for r in got.collect()} == {"allow", "block"} and any(r["template"].count("/*") > 2 for r in got.collect())


@pytest.mark.parametrize("seed", range(3))
def test_no_near_pair_is_missed_by_wide_plans(spark, monkeypatch, seed):
    monkeypatch.setattr(simhash, "SHARD", 60)
    monkeypatch.setattr(simhash, "LEAF", 6)
    monkeypatch.setattr(simhash, "WIDE", 10)
    rng = random.Random(seed)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 9])):
            fps.add(x)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
    ids = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(i, bytearray(x.to_bytes(8, "big"))) for i, x in ids.items()], "rep long, fp binary")
    assert simhash.Plan.exact().fitted(11).radius == 2
    edges = [(r["a"], r["b"]) for r in simhash.links(nodes, simhash.Plan.exact()).collect()]
    assert _smallest(ids, edges) == _smallest(ids, [(a, b) for a in ids for b in ids if a < b and (ids[a] ^ ids[b]).bit_count() <= 4])
