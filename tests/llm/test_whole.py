"""Whole results: nothing lost by an estimate, a gate or an id."""

import random

import numpy as np

import corpus_pipeline
from millrace.llm import simhash
from tests.llm.test_brute import _smallest


def _documents(spark, texts):
    rows = [(i, t, "en", "web", len(t)) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# --- near-dedup ----------------------------------------------------------------------


def _variants():
    """Texts of 300 words and copies of them with 1 to 14 words changed, whose similarities lie around 0.8."""
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts.append(" ".join(base))
        for changed in range(1, 15):
            other = list(base)
            for spot in rng.sample(range(5, 295), changed):
                other[spot] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    return dict(enumerate(texts))


def _true_roots(texts, words=5):
    sets = {i: set(zip(*[t.lower().split()[k:] for k in range(words)])) for i, t in texts.items()}
    alike = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return _smallest(sets, alike)


def test_near_dedup_links_by_true_similarity(spark):
    texts = _variants()
    roots = _true_roots(texts)
    assert len(texts) > len(set(roots.values())) > 12
    kept = corpus_pipeline.near_dedup(spark, _documents(spark, texts.items()), "").collect()
    assert {r["doc_id"] for r in kept} == {i for i in texts if roots[i] == i}


def test_a_forest_of_candidates_is_enough():
    # 0 and 2 lie near 1; which of the three pairs hold is found by the sets alone
    fps = np.array([[0], [1], [3]], dtype=np.uint64)
    tree = simhash.pairs(fps, 3, np.zeros(3, dtype=np.uint64), np.array([10, 10, 10]), 2, 1)
    assert sorted(map(sorted, tree.tolist())) == [[0, 1], [1, 2]]


def _sets(rng):
    """Sets around a few centres, with similarities on both sides of 0.8."""
    out = []
    for _ in range(6):
        centre = rng.sample(range(10**6), 40)
        for _ in range(rng.randrange(1, 14)):
            out.append(sorted({*rng.sample(centre, rng.randrange(28, 41)), *(rng.randrange(10**6) for _ in range(rng.randrange(4)))}))
    return [[], [], *out]


def _links(sets):
    alike = lambda x, y: 5 * len(set(x) & set(y)) >= 4 * len(set(x) | set(y))
    return [(a, b) for a in range(len(sets)) for b in range(a) if alike(sets[a], sets[b])]


def test_true_links():
    for seed in range(12):
        sets = _sets(random.Random(seed))
        arrays = [np.array(x, dtype=np.int64) for x in sets]
        got = simhash.true_links(arrays, np.arange(len(sets))).tolist()
        assert set(map(tuple, map(sorted, got))) <= {tuple(sorted(x)) for x in _links(sets)} and len(got) < len(sets)
        assert _smallest(range(len(sets)), got) == _smallest(range(len(sets)), _links(sets))
    assert simhash.true_links([], np.zeros(0, dtype=int)).tolist() == []


def test_parts_of_large_groups_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 200)
    rng = random.Random(4)
    sets = _sets(rng)
    root = [i % 2 for i in range(len(sets))]
    some = [(a, b) for a, b in _links(sets) if root[a] == root[b] and rng.random() < 0.2]
    part = _smallest(range(len(sets)), some)
    parts = spark.createDataFrame([(i, root[i], part[i], len(x)) for i, x in enumerate(sets)], "node long, root long, part long, size long")
    held = spark.createDataFrame(list(enumerate(sets)), "rep long, set array<long>")
    more = [(r["a"], r["b"]) for r in simhash._rest(parts, held).collect()]
    want = [(a, b) for a, b in _links(sets) if root[a] == root[b]]
    assert more and set(more) <= {(b, a) for a, b in want}
    assert _smallest(range(len(sets)), some + more) == _smallest(range(len(sets)), want)


def test_near_dedup_goes_by_rows_not_by_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a), (None, c), (None, c), (None, b)]
    kept = corpus_pipeline.near_dedup(spark, _documents(spark, rows), "").collect()
    assert sorted((str(r["doc_id"]), r["text"][0]) for r in kept) == [("1", "a"), ("1", "b"), ("None", "c")]
