"""Toxicity by a classifier chain.

The categories are predicted one after another by linear (logistic) models over the
presence of words and word stems. Each model also gets the probabilities of the categories before it;
in training these are out-of-fold, so that a model meets probabilities as uncertain as
those it will meet later.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import free, ship, table

#: About so many labelled rows train the chain (a bounded sample of the labelled rows, by a hash of the id).
SAMPLE_ROWS = 12_000
FEATURES = 256
FOLDS = 5
L2 = 1.0
#: A feature of fewer texts than this tells nothing.
RARE = 3
#: A document is toxic from this probability of the category ``toxic`` on.
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(has: set[str]) -> set[str]:
    """The words themselves and their stems (the first 4 and 5 letters, marked)."""
    found = set()
    for w in has:
        found.add(w)
        if len(w) > 3:
            found.add(w[:4] + "~")
            if len(w) > 4:
                found.add(w[:5] + "~")
    return found


def _numbered(texts: list[str]) -> tuple[list[np.ndarray], dict[str, int]]:
    """The features of each text as numbers, and the number of each; numbers go by the first text, then by the feature.

    Features of fewer than RARE texts, which no model takes, get none. Those of a word are
    looked up once for all texts.
    """
    seen: dict[str, int] = {}
    of_word: dict[str, tuple[int, ...]] = {}
    rows, held = [], []
    for t in texts:
        found: set[int] = set()
        for w in t.split():
            if (own := of_word.get(w)) is None:
                own = of_word[w] = tuple(seen.setdefault(f, len(seen)) for f in features({w}))
            found.update(own)
        rows.append(np.fromiter(found, dtype=np.int32, count=len(found)))
        held.append(len(seen))
    del of_word
    often = np.zeros(len(seen), dtype=np.int64)
    for r in rows:
        often[r] += 1
    kept = {f: i for f, i in seen.items() if often[i] >= RARE}
    del seen
    names = sorted(kept)
    ids = np.array([kept[f] for f in names], dtype=np.int64)
    order = np.argsort(np.searchsorted(np.array(held), ids, side="right"), kind="stable")
    number = np.full(len(often), -1, dtype=np.int32)
    number[ids[order]] = np.arange(len(ids))
    return [n[n >= 0] for n in (number[r] for r in rows)], {names[i]: k for k, i in enumerate(order.tolist())}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _telling(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """The FEATURES features (of ``size``) whose presence tells most about ``y``, by a smoothed z-score of their two rates."""
    if not rows:
        return np.zeros(0, dtype=int)
    at = np.concatenate(rows)
    label = np.repeat(y == 1, [len(r) for r in rows])
    c = np.stack([np.bincount(at[x], minlength=size) for x in (~label, label)], axis=1).astype(float)
    n = np.array([(y == 0).sum(), (y == 1).sum()], dtype=float) + 1
    rate = (c + 0.5) / n
    pooled = (c.sum(axis=1) + 1) / n.sum()
    z = np.abs(rate[:, 1] - rate[:, 0]) / np.sqrt(pooled * np.maximum(1 - pooled, 1e-3) * (1 / n).sum())
    z[c.sum(axis=1) < RARE] = -1
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return best[z[best] >= 0]


def _matrix(rows: list[np.ndarray], chosen: np.ndarray, size: int, earlier: np.ndarray) -> np.ndarray:
    at = np.full(size + 1, -1, dtype=np.int32)
    at[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen) + earlier.shape[1] + 1))
    if rows:
        column = at[np.concatenate(rows)]
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        x[row[column >= 0], column[column >= 0]] = 1
    x[:, len(chosen) : -1] = earlier
    x[:, -1] = 1
    return x


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method with an L2 penalty on all but the intercept."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], L2)
    penalty[-1] = 1e-3
    for _ in range(12):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """The fitted chain: for each category its features and weights."""

    def __init__(self, categories: list[str]) -> None:
        self.categories = categories
        self.known: dict[str, int] = {}
        self.models: list[tuple[np.ndarray, np.ndarray]] = []

    def fit(self, texts: list[str], labels: np.ndarray, folds: np.ndarray) -> Chain:
        """``texts``: the words of each text, space-joined."""
        rows, seen = _numbered(texts)
        size = len(seen)
        held = np.zeros((len(rows), 0))
        for c in range(len(self.categories)):
            y = labels[:, c]
            out = np.zeros(len(rows))
            for f in range(FOLDS):
                train, test = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
                if len(train) and len(test):
                    some = [rows[i] for i in train]
                    chosen = _telling(some, y[train], size)
                    w = _logistic(_matrix(some, chosen, size, held[train]), y[train])
                    out[test] = _sigmoid(_matrix([rows[i] for i in test], chosen, size, held[test]) @ w)
            chosen = _telling(rows, y, size)
            self.models.append((chosen, _logistic(_matrix(rows, chosen, size, held), y) if rows else np.array([0.0] * c + [-30.0])))
            held = np.column_stack((held, out))
        used = set(np.concatenate([m[0] for m in self.models]).tolist()) if self.models else set()
        kept = sorted((f, i) for f, i in seen.items() if i in used)  # only what a model uses goes to the executors
        new = {i: k for k, (_, i) in enumerate(kept)}
        self.known = {f: new[i] for f, i in kept}
        self.models = [(np.array([new[i] for i in m.tolist()], dtype=int), w) for m, w in self.models]
        return self

    def predict(self, texts: list[str | None]) -> np.ndarray:
        # the features of each kind (words, stems of 4 and of 5 letters) that a model uses
        whole, *stems = [{f.rstrip("~"): i for f, i in self.known.items() if (len(f) if f.endswith("~") else 0) == n} for n in (0, 5, 6)]

        def used(has: set[str]) -> np.ndarray:
            found = [whole[w] for w in has & whole.keys()]
            for n, known in zip((4, 5), stems):
                found += [known[w] for w in {w[:n] for w in has if len(w) >= n} & known.keys()]
            return np.array(found, dtype=np.int64)

        rows = [used(words(t)) for t in texts]
        p = np.zeros((len(rows), 0))
        for chosen, w in self.models:
            p = np.column_stack((p, _sigmoid(_matrix(rows, chosen, len(self.known), p) @ w)))
        return p


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Trains a chain on about ``sample_rows`` of the labelled documents.

    ``categories`` gives for each category, in the order of the chain, a boolean column of
    ``labels``; null counts as false. Only the words of the sample reach the driver, once
    an id: of an id with several texts the one whose words sort first teaches, and labels
    of one id that differ count as true. Without labelled rows every probability is
    nearly 0.
    """
    spark = docs.sparkSession
    ship(spark)
    n = labels.count()
    share = min(1.0, sample_rows / max(1, n))
    own = labels.select(F.col(key).alias("__key"), *[F.coalesce(c, F.lit(False)).cast("int").alias(f"__y{i}") for i, c in enumerate(categories.values())]).where(F.col("__key").isNotNull())
    if share < 1:
        own = own.where(F.pmod(F.xxhash64(F.lit(17), "__key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    own = own.groupBy("__key").agg(*[F.max(c).alias(c) for c in own.columns[1:]])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(1, "__words", pa.array([" ".join(sorted(words(x))) for x in batch.column(1).to_pylist()]))

    # at most the sample is broadcast: ids and labels, some 20 bytes a row; of several texts of one id the first in order counts
    picked = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__words")).join(F.broadcast(own), "__key")
    single = picked.mapInArrow(gather, picked.schema).groupBy(*[c for c in picked.columns if c != "__words"]).agg(F.min("__words").alias("__words"))
    got = single.select("*", F.pmod(F.crc32(F.col("__key").cast("string").cast("binary")), F.lit(FOLDS)).alias("__fold")).collect()
    got.sort(key=lambda r: (r["__key"], r["__words"]))
    y = np.array([[r[f"__y{i}"] for i in range(len(categories))] for r in got], dtype=int).reshape(-1, len(categories))
    return Chain(list(categories)).fit([r["__words"] for r in got], y, np.array([r["__fold"] for r in got], dtype=int))


def score(docs: DataFrame, chain: Chain, text: str = "text", decided_by: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category and the boolean ``toxic``.

    Null and empty texts have no words and get what the models say of none. Texts of any
    length are read whole; only which words occur counts. Equal texts get equal
    probabilities, and a probability at the threshold is toxic. All columns and repeated
    rows pass through; columns with these names are replaced.
    """
    ship(docs.sparkSession)
    new = [f"p_{c}" for c in chain.categories] + ["toxic"]
    docs = free(docs, new)
    at, decider = docs.columns.index(text), chain.categories.index(decided_by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                p = chain.predict(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(p[:, decider] >= threshold)], [*batch.schema.names, *new])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.DoubleType()) for x in new[:-1]), T.StructField("toxic", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def chain_categories() -> dict[str, Column]:
    """The categories that the table ``labels`` can teach: junk, then toxic, then both at once."""
    return {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "severe": (F.col("toxic") == 1) & (F.col("quality") == 0)}


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's probabilities for every document, and whether it is toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"), chain_categories())).drop("text")
