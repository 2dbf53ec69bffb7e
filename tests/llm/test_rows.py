"""What every operator makes of nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, decontam, langid, licenses, linededup, quality, sharding, simhash, toxicity, urlfilter

LONG = "All of this is one long line of prose, without an end in sight. " * 2000
EXTRA = "n_words long, score string, shard int, h int, i int, kept string, labels string, ids int, lang_pred int, toxic int, base int, fp int, template string, __drop int, __m int, __found int, __row int, gone int, row int, tags map<string,int>"


def _rows():
    texts = [(1, "One fine day it rained."), (1, "One fine day it rained."), (None, "nobody"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG), (7, "x" * 70_000), (8, "Ünïcödé\u00a0漢字 🙂.\n" * 3), (None, None), (8, "another text of eight")]
    return [(i, t, None, None, None, *[None] * 19, {"a": 1, "b": 2}) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "nothing like this occurs anywhere at all"), (None, "x"), (2, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "shard": lambda d: sharding.assign_shards(d, 5),
    "quality": quality.clean,
    "lines": linededup.drop_recurring,
    "bpe": lambda d: bpe.decode(bpe.encode(d, bpe.public_vocabulary()), bpe.public_vocabulary()),
    "licenses": licenses.scan,
    "language": lambda d: langid.identify(d, langid.fit(d)),
    "simhash": lambda d: simhash.groups(d, simhash.Plan.exact()),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.select("doc_id", F.lit(None).cast("int").alias("toxic"), F.lit(1).alias("quality")), toxicity.chain_categories())),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, name):
    out = OPERATORS[name](docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r[0]) for r in _rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, name):
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_matches_of_odd_rows(docs, items):
    assert decontam.matches(docs, items).collect() == []
    assert decontam.matches(docs, items.limit(0)).collect() == []
    assert decontam.decontaminated(docs, items).count() == len(_rows())
    hit = items.limit(0).union(docs.sparkSession.createDataFrame([(9, "one LINE of  prose, without an end")], items.schema))
    assert {r["doc_id"] for r in decontam.matches(docs, hit).collect()} == {5, 6}


def test_urls_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, 1), (None, "http://a.org", 2), (2, "", 3), (2, "", 3), (3, "no scheme", 4), (4, "x://HOST.com?q/://y", 5), (5, "a://h.com/de/x#/y", 6)], "page_id long, url string, host int")
    got = {(r["page_id"], r["host"], r["path"], r["rule"]) for r in urlfilter.judge(pages).collect()}
    assert got == {(1, "", "", None), (None, "a.org", "", None), (2, "", "", None), (3, "", "", None), (4, "host.com", "", None), (5, "h.com", "/de/x", "com/de/")}
    assert urlfilter.judge(pages).count() == 7 and urlfilter.judge(pages.limit(0)).count() == 0


def test_pipeline_of_odd_rows(spark, docs, tmp_path):
    items = spark.createDataFrame([(1, "nothing like this occurs anywhere at all")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, docs.limit(0), docs.select("doc_id", "text", "lang", "source", "n_chars")):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == rows.columns
            assert now.count() <= rows.count()
        out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert all(r["round_trip"] for r in out.collect())
