"""The pipeline against plain programs, stage by stage, and as a whole."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import bpe, common, decontam, linededup, quality
from tests.conftest import DATA
from tests.llm.test_brute import _smallest

WORDS = re.compile(quality.WORD)
N = 120
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_line_passes(line):
    n, symbols, bars = len(WORDS.findall(line)), sum(line.count(c) for c in quality.SYMBOLS), line.count("|") + line.count(">")
    if not n or not re.search(quality.ENDS, line) or symbols > quality.LINE_SYMBOLS * len(line) or re.search(quality.SHOUTING, line):
        return False
    steps, low = len(re.findall(quality.STEP, line)), line.lower()
    if bars >= quality.SEPARATORS or (steps >= quality.TRAIL_STEPS and n - steps <= quality.STEP_WORDS * (steps + 1)) or re.search(quality.LABEL, low):
        return False
    return len(re.findall(quality.BOILERPLATE, low)) * quality.PHRASE_WORDS < n


def plain_quality(docs):
    out = {}
    for i, text in docs.items():
        words = WORDS.findall(text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {p + k for p, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        if len(words) < quality.MIN_WORDS or 100 * len(repeated) > quality.REPEAT_PERCENT * len(words):
            continue
        good = [line for line in text.split("\n") if plain_line_passes(line)]
        if sum(len(WORDS.findall(x)) for x in good) >= quality.KEPT_SHARE * len(words):
            out[i] = "\n".join(good)
    return out


def plain_lines(docs):
    lines = [(i, k, tuple(WORDS.findall(re.sub(linededup.NUMBERED, "<*>", line)))) for i, t in docs.items() for k, line in enumerate(t.split("\n")) if WORDS.search(line)]
    holders = defaultdict(set)
    for i, _, t in lines:
        holders[t].add(i)
    leaves = defaultdict(list)
    for t in holders:
        leaves[len(t), t[: linededup.DEPTH]].append(t)
    template = {t: t for t in holders}
    for (n, _), kinds in leaves.items():
        if len(kinds) < 2 or sum(len(holders[t]) for t in kinds) < linededup.MIN_DOCS:
            continue
        seen = Counter()
        for t in kinds:
            for spot in enumerate(t):
                seen[spot] += len(holders[t])
        for t in kinds:
            constant = tuple(s for s in enumerate(t) if seen[s] >= linededup.MIN_DOCS)
            if len(constant) >= linededup.CONSTANT * n:
                template[t] = (n, t[: linededup.DEPTH], constant)
    having = defaultdict(list)
    for i, k, t in lines:
        having[template[t]].append((i, k))
    gone = {x for at in having.values() if len({i for i, _ in at}) >= linededup.MIN_DOCS for x in at if x != min(at)}
    out = {}
    for i, text in docs.items():
        left = "\n".join(line for k, line in enumerate(text.split("\n")) if (i, k) not in gone)
        if left == text or WORDS.search(left):
            out[i] = left
    return out


def plain_near(docs):
    """Sets of five-word shingles, compared pair by pair."""
    words = {i: [w.translate(LOW) for w in WORDS.findall(t)] for i, t in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    roots = _smallest(sets, near)
    return {i: t for i, t in docs.items() if roots[i] == i}


def plain_leaks(docs, items):
    def holds(text, item):
        k = int(len(item) * decontam.EDITS)
        return f" {item} " in f" {text} " if k == 0 else decontam.myers(item, text, k) is not None

    wanted = [n for t in items if (n := decontam.normalised(t))]
    return {i: t for i, t in docs.items() if not any(holds(decontam.normalised(t), n) for n in wanted)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A fixture of N documents, with the hot lines and copies among them."""
    place = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(f"doc_id < {N}")
    more = docs.where("doc_id < 14").selectExpr("doc_id + 1000 AS doc_id", "concat(text, '\nEntry ', doc_id, ' of the long list of things.') AS text", "lang", "source", "n_chars")
    docs.unionByName(more).write.parquet(f"{place}/documents.parquet")
    short = spark.createDataFrame([(None, "of the long list"), (9001, "long lis")], "item_id long, text string")
    spark.read.parquet(f"{DATA}/benchmark.parquet").limit(15).unionByName(short).write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    plain = {r["doc_id"]: r["text"] for r in docs.collect()}
    for (_, stage), expect in zip(corpus_pipeline.STAGES, [plain_quality, plain_lines, plain_near, lambda d: plain_leaks(d, items)]):
        out = stage(spark, docs, folder)
        rows = out.collect()
        plain = expect(plain)
        assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in rows} == plain
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        docs = spark.createDataFrame(rows, out.schema)
    encoding = bpe.public_vocabulary().encoding()
    want = {i: hashlib.sha256(np.array(encoding.encode_ordinary(t), dtype="<u4").tobytes()).hexdigest() for i, t in plain.items()}
    got = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in got} == want and all(r["round_trip"] for r in got)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in whole} == want


def python_at_once(plan, above=0):
    """The most Python operators that one task of a physical plan runs at once."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return python_at_once(plan.executedPlan())
    own = 0 if "Exchange" in plan.nodeName() else above + ("Arrow" in plan.nodeName())
    children = plan.children()
    return max([own, above, *(python_at_once(children.apply(i), own) for i in range(children.size()))])


def test_encoding_keeps_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    encoded = corpus_pipeline.encode(spark, docs, DATA)
    assert python_at_once(encoded._jdf.queryExecution().executedPlan()) == 1


def test_decoding_at_once_is_decoding_after(spark):
    long = "grüße, 12 Bäume \n" * (2 * bpe.SPREAD * bpe.CHUNK // 16)
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "y"), (3, "", None), (4, long, "z"), (4, long, "z")], "doc_id long, text string, decoded string")
    vocabulary = bpe.public_vocabulary()
    once = bpe.encode(docs, vocabulary, decoded="decoded")
    after = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    assert once.columns == after.columns == ["doc_id", "text", "ids", "decoded"]
    held = sorted(once.collect(), key=str)
    assert held == sorted(after.collect(), key=str) and len(held) == 6
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in held)


def test_a_run_leaves_only_what_its_result_reads(spark, folder):
    common.forget(spark)
    before = common.written()
    rows = corpus_pipeline.run(spark, folder)
    assert before == 0 and common.written() == 1 and rows.count() > 0


def test_maps_and_clashing_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = ["row", "key", "other", "id", "h", "gone", "part", "kept", "rest", "ids", "n", "__row", "clean_text", "n_words"]
    wide = docs.selectExpr("*", "map('a', doc_id, 'b', n_chars) AS tags", *[f"doc_id * {i} AS `{c}`" for i, c in enumerate(odd)])
    narrow = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide, narrow = stage(spark, wide, folder), stage(spark, narrow, folder)
        assert wide.columns == [*docs.columns, "tags", *odd]
    rows = wide.collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in narrow.collect())
    assert all(r["tags"]["a"] == r["doc_id"] and all(r[c] == r["doc_id"] * i for i, c in enumerate(odd)) for r in rows)


def test_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "encoding"]
