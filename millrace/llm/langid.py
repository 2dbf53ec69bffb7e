"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, a function of its code point. A trigram
abc is bound as rho(rho(a)) * rho(b) * c, where rho rotates by one place; a text is the
bundle (sum) of its trigrams; a language is the bundle of its training texts. A text
gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import free, ship, table

DIMENSIONS = 1024
SEED = 1009
#: About so many labelled rows train the prototypes (a bounded sample of the labelled rows, by a hash of the id).
SAMPLE_ROWS = 20_000
PIECE = 1 << 20
BLOCK = 8192
UND = "und"


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it is none."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        if unicodedata.category(c := chr(i))[0] == "L":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


@lru_cache(maxsize=65536)
def _letter(code: int) -> np.ndarray:
    return (np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


@lru_cache(maxsize=32768)
def _trigram(key: int) -> np.ndarray:
    a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
    return np.roll(_letter(a), 2) * np.roll(_letter(b), 1) * _letter(c)


def _codes(text: str) -> np.ndarray:
    """Lower-case letters of ``text``; every run of other characters, and both ends, are one space."""
    codes = _lower_letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    return codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text, and whether it has a letter.

    Texts are taken together up to PIECE letters; longer ones alone, in overlapping pieces.
    """
    out, some = np.zeros((len(texts), DIMENSIONS)), np.zeros(len(texts), dtype=bool)
    keys: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not keys:
            return
        first, last = owners[0][0], owners[-1][0]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        who = np.concatenate(owners) - first
        for lo in range(0, len(found), BLOCK):
            vectors = np.stack([_trigram(int(k)) for k in found[lo : lo + BLOCK]]).astype(np.float32)
            inside = (at >= lo) & (at < lo + BLOCK)
            for d in range(0, last - first + 1, 64):
                mine = inside & (who >= d) & (who < d + 64) if last - first >= 64 else inside
                rows = min(64, last - first + 1 - d)
                counts = np.bincount((who[mine] - d) * len(vectors) + at[mine] - lo, minlength=rows * len(vectors))
                out[first + d : first + d + rows] += counts.reshape(rows, -1).astype(np.float32) @ vectors
        keys.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        codes = _codes(text)
        if len(codes) < 3:
            continue
        some[i] = True
        for lo in range(0, len(codes) - 2, PIECE):
            c = codes[lo : lo + PIECE + 2]
            keys.append((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])
            owners.append(np.full(len(c) - 2, i, dtype=np.int64))
            held += len(c)
            if held >= PIECE // 4:
                flush()
    flush()
    return out, some


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """The prototypes, by language, from about ``sample_rows`` rows of ``df`` that have a language.

    Rows are taken where a hash of ``key`` is below a share of its range. Sums are of
    whole numbers, so their order does not matter. Rows without text or language
    teach nothing; an empty frame gives no prototypes.
    """
    ship(df.sparkSession)
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = min(1.0, sample_rows / max(1, known.count()))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lo in range(0, len(texts), 256):
                vectors, _ = bundles(texts[lo : lo + 256])
                for one in set(langs[lo : lo + 256]):
                    mine = [x == one for x in langs[lo : lo + 256]]
                    sums[one] = sums.get(one, 0) + vectors[mine].sum(axis=0)
        for one, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([one] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total.astype(np.int64))], ["lang", "at", "value"])

    rows = known.select(text, lang).mapInArrow(partial, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()
    found: dict[str, np.ndarray] = {}
    for r in rows:
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["at"]] = r["value"]
    return {k: v / n for k, v in sorted(found.items()) if (n := np.linalg.norm(v))}


def identify(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (the cosine, from 0 to 1).

    A null text, one without a letter, or an empty set of prototypes gives ``und`` and
    0; ties go to the first language in order. All columns of ``df`` pass through;
    ``lang_pred`` and ``score`` among them are replaced.
    """
    df = free(df, ["lang_pred", "score"])
    ship(df.sparkSession)
    names, matrix = list(prototypes), np.array(list(prototypes.values())).reshape(-1, DIMENSIONS)
    at = df.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                vectors, some = bundles(batch.column(at).to_pylist())
                length = np.linalg.norm(vectors, axis=1)
                some &= length > 0
                if names:
                    cosine = vectors @ matrix.T / np.maximum(length, 1)[:, None]
                    best = cosine.argmax(axis=1)
                    score = np.where(some, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0)
                    said = [names[b] if ok else UND for b, ok in zip(best, some)]
                else:
                    said, score = [UND] * batch.num_rows, np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.mapInArrow(predict, schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; documents whose crc32 of the id leaves 0 by 5 are held out of training."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(key) % 5 == 0)
    prototypes = fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), prototypes).drop("text")
