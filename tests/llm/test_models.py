"""The trained operators and the decontamination query against plain programs on small inputs."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np

from millrace.llm import decontam, langid, toxicity
from tests.conftest import DATA
from tests.llm.test_brute import _distance

# --- 8: the chain, step by step ------------------------------------------------------


def _features(text):
    words = set(text.split())
    return words | {w[:4] + "~" for w in words if len(w) >= 4} | {w[:5] + "~" for w in words if len(w) >= 5}


def _chosen(sets, y):
    """The features that tell most about y, by the z-score of their smoothed rates; the first seen wins a tie."""
    order = {}
    for s in sets:
        for f in sorted(s):
            order.setdefault(f, len(order))
    n = [sum(1 for v in y if v == k) + 1 for k in (0, 1)]
    scored = []
    for f, place in order.items():
        c = [sum(1 for s, v in zip(sets, y) if v == k and f in s) for k in (0, 1)]
        if sum(c) >= 3:
            pooled = (sum(c) + 1) / sum(n)
            spread = math.sqrt(pooled * max(1 - pooled, 1e-3) * (1 / n[0] + 1 / n[1]))
            scored.append((-abs((c[1] + 0.5) / n[1] - (c[0] + 0.5) / n[0]) / spread, place, f))
    return [f for _, _, f in sorted(scored)[: toxicity.FEATURES]]


def _slope(rows, y, w):
    """The slope of the penalised log likelihood at w."""
    out = [-(1e-3 if j == len(w) - 1 else toxicity.L2) * v for j, v in enumerate(w)]
    for x, t in zip(rows, y):
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, w))))
        out = [o + (t - p) * a for o, a in zip(out, x)]
    return out


def _probability(x, w):
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, w))))


def _labelled(n=90):
    rng = random.Random(3)
    common, junk, bad = [f"plain{c}" for c in "abcdefgh"], ["click", "winner", "cheap"], ["idiot", "scum", "vermin"]
    texts, labels = [], []
    for _ in range(n):
        j, t = rng.random() < 0.4, rng.random() < 0.35
        words = set(rng.sample(common, 4)) | (set(rng.sample(junk, 2)) if j else set()) | (set(rng.sample(bad, 2)) if t else set())
        texts.append(" ".join(sorted(words)))
        labels.append([int(j != (rng.random() < 0.1)), int(t), int(j and t)])
    return texts, labels, [i % toxicity.FOLDS for i in range(n)]


def test_chain_step_by_step():
    """Every model is the optimum over features chosen by hand; later models learn from out-of-fold probabilities."""
    texts, labels, folds = _labelled()
    chain = toxicity.Chain(["junk", "toxic", "severe"]).fit(texts, np.array(labels), np.array(folds))
    name = {i: f for f, i in chain.known.items()}
    sets = [_features(t) for t in texts]
    held = [[] for _ in texts]
    for c, (chosen, weights) in enumerate(chain.models):
        y = [v[c] for v in labels]
        assert [name[i] for i in chosen.tolist()] == _chosen(sets, y)
        row = lambda i, fs: [float(f in sets[i]) for f in fs] + held[i] + [1.0]
        rows = [row(i, _chosen(sets, y)) for i in range(len(texts))]
        assert max(map(abs, _slope(rows, y, weights.tolist()))) < 1e-3
        out = {}
        for fold in range(toxicity.FOLDS):
            train = [i for i in range(len(texts)) if folds[i] != fold]
            fs = _chosen([sets[i] for i in train], [y[i] for i in train])
            x = np.array([row(i, fs) for i in train])
            w = toxicity._logistic(x, np.array([y[i] for i in train]))
            assert max(map(abs, _slope(x.tolist(), [y[i] for i in train], w.tolist()))) < 1e-3
            out |= {i: _probability(row(i, fs), w.tolist()) for i in range(len(texts)) if folds[i] == fold}
        held = [h + [out[i]] for i, h in enumerate(held)]


def test_chain_predicts_in_sequence():
    texts, labels, folds = _labelled()
    chain = toxicity.Chain(["junk", "toxic", "severe"]).fit(texts, np.array(labels), np.array(folds))
    new = ["An IDIOT, such SCUM!", "plaina plainb", "", None, "vermin vermin scum"]
    got = chain.predict(new)
    name = {i: f for f, i in chain.known.items()}
    for text, p in zip(new, got.tolist()):
        has = _features(" ".join(toxicity.words(text)))
        earlier = []
        for chosen, w in chain.models:
            earlier.append(_probability([float(name[i] in has) for i in chosen.tolist()] + earlier + [1.0], w.tolist()))
        assert np.allclose(p, earlier)
    assert got[0, 1] > 0.5 > got[1, 1] and got[4, 1] > 0.5


# --- 10: the query, document by document ---------------------------------------------


def _trigrams(text):
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " " for c in text or "")
    padded = f" {' '.join(letters.split())} "
    return Counter(zip(padded, padded[1:], padded[2:])) if letters.strip() else Counter()


def test_language_query_against_a_plain_program(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r["doc_id"]: r for r in langid.op10_language(spark, DATA).collect()}
    vector = lambda counts: sum((n * (np.roll(langid._letter(ord(a)), 2) * np.roll(langid._letter(ord(b)), 1) * langid._letter(ord(c))).astype(np.int64) for (a, b, c), n in counts.items()), np.zeros(langid.DIMENSIONS, dtype=np.int64))
    bundles = {r["doc_id"]: vector(_trigrams(r["text"])) for r in rows}
    prototypes = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and not got[r["doc_id"]]["held_out"]:
            prototypes[r["lang"]] = prototypes.get(r["lang"], 0) + bundles[r["doc_id"]]
    for r in rows:
        v, said = bundles[r["doc_id"]], got[r["doc_id"]]
        if not v.any():
            assert (said["lang_pred"], said["score"]) == ("und", 0)
            continue
        cosines = {k: float(v @ p) / float(np.linalg.norm(v) * np.linalg.norm(p)) for k, p in prototypes.items()}
        best = max(cosines.values())
        assert abs(said["score"] - max(0, best)) < 1e-9 and best - cosines[said["lang_pred"]] < 1e-9


# --- 5: the query ---------------------------------------------------------------------


def test_decontamination_query_against_every_item(spark, tmp_path):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(50)]
    # items with a common beginning share pieces
    items = [(i, " ".join(words[:3] + [rng.choice(words) for _ in range(9)])) for i in range(12)]
    texts = []
    for i in range(40):
        chars = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 8)):
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
        texts.append((i, " ".join(rng.choice(words) for _ in range(20)) + " " + "".join(chars) + " " + " ".join(rng.choice(words) for _ in range(20))))
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {(i, j, d) for i, t in texts for j, item in items if (d := _distance(item, t)) <= int(len(item) * decontam.EDITS)}
    got = decontam.op5_decontaminate(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want and len(got) == len(want) > 20
    assert all(r["contained"] == (r["distance"] == 0) for r in got)
