"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with at most ``k`` edits, a share of its length. Cut
into k + 1 pieces, at least one piece must then occur exactly. One Aho-Corasick
automaton finds the pieces of a block of items in each document; every hit tells where
the item would lie, and Myers' bit-parallel algorithm measures the edit distance there.
An item so short that no edit is allowed is its only piece; it counts where it stands
between the ends of words, as it would occur inside longer words by chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ship, table, tidy

#: Edits allowed, as a share of an item's normalised length.
EDITS = 0.06
#: Characters of items in one automaton; more items are searched for block by block.
BLOCK_CHARS = 4_000_000
_OTHER = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    """Lower-cased; every run of anything but letters and digits is one space."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``item`` in k + 1 nearly equal pieces, each with its start."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """The least edit distance of ``pattern`` to any part of ``text`` and where the first such part ends; None above ``k``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = (m, 0)
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
        if score < best:
            best, at = score, j
    return (best, at) if best <= k else None


def _joined(a: str, b: str) -> bool:
    """Whether two characters side by side belong to one word; scripts without spaces have no words of this kind."""
    return a.isalnum() and b.isalnum() and max(a, b) < "\u2e80"


class Matcher:
    """The items of one block; equal texts are searched for once."""

    def __init__(self, items: list[tuple[int | None, str]], edits: float = EDITS) -> None:
        ids: dict[str, list[int | None]] = {}
        for item_id, text in items:
            if text:
                ids.setdefault(text, []).append(item_id)
        self.items = [(same, text, int(len(text) * edits)) for text, same in ids.items()]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k) in enumerate(self.items):
            for start, piece in pieces(text, k):
                where.setdefault(piece, []).append((i, start))
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def _whole(self, item: str, text: str, starts: list[int]) -> int | None:
        """Where ``item`` first ends in ``text`` between the ends of words."""
        for s in starts:
            e = s + len(item)
            if not (s and _joined(text[s - 1], item[0])) and not (e < len(text) and _joined(item[-1], text[e])):
                return e
        return None

    def _near(self, item: str, k: int, text: str, starts: list[int]) -> tuple[int, int] | None:
        """The least distance of ``item`` to a part of ``text`` around its hits, and where that part ends."""
        if (exact := text.find(item, max(0, starts[0]))) >= 0:
            return 0, exact + len(item)
        best, windows = None, []
        for s in sorted(starts):  # windows of hits that overlap are verified as one
            a, b = max(0, s - k), s + len(item) + k
            if windows and a <= windows[-1][1] - len(item):
                windows[-1] = (windows[-1][0], max(windows[-1][1], b))
            else:
                windows.append((a, b))
        for lo, hi in windows:
            if (m := myers(item, text[lo:hi], k)) and (best is None or m[0] < best[0]):
                best = (m[0], lo + m[1])
        return best

    def spans(self, text: str) -> dict[int, list[int]]:
        """For each item of which a piece occurs, where it would start by that piece."""
        found: dict[int, list[int]] = {}
        if len(self.automaton):
            for end, (length, at) in self.automaton.iter(text):
                for i, start in at:
                    found.setdefault(i, []).append(end + 1 - length - start)
        return found

    def find(self, text: str, first: bool = False) -> list[tuple[int | None, int, int]]:
        """For each item in the normalised ``text``: its id, least distance and where that match ends; one is enough if ``first``."""
        out = []
        for i, starts in self.spans(text).items():
            ids, item, k = self.items[i]
            if k == 0:
                best = (0, e) if (e := self._whole(item, text, starts)) is not None else None
            else:
                best = self._near(item, k, text, starts)
            if best is not None:
                out += [(item_id, *best) for item_id in ids]
                if first:
                    break
        return out


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, str]]]:
    block: list[tuple[int | None, str]] = []
    held = 0
    for r in items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).orderBy("i", "t").toLocalIterator():
        value = normalised(r["t"])
        if not value:
            continue
        block.append((r["i"], value))
        held += len(value)
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """One row for each document and item that occurs in it: doc_id, item_id, distance, match_end, contained.

    ``match_end`` counts characters of the normalised text; ``contained`` is true where
    the distance is 0; of equally near places the first counts. Items go to the executors
    in blocks of at most BLOCK_CHARS characters, so that what is sent has a bound at any
    number of items. Null texts, and texts without a letter or digit, match nothing. Null
    ids of documents and items match and are given as null. A repeated document gives
    its rows again, a repeated item too. Texts of any length are searched whole, in time
    that grows with their length. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "doc_id long, item_id long, distance int, match_end long, contained boolean"
    out = None
    for block in _blocks(items, item_id, item_text):
        held = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, edits)
            for batch in batches:
                found = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for m in matcher.find(normalised(t))]
                if found:
                    ids, which, distance, end = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(which, pa.int64()), pa.array(distance, pa.int32()), pa.array(end, pa.int64()), pa.array([d == 0 for d in distance])],
                        ["doc_id", "item_id", "distance", "match_end", "contained"],
                    )

        one = rows.mapInArrow(search, schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """``docs`` without the rows in whose text an item occurs; all columns stay.

    Each row is judged where it lies, by its text alone: ids may be null or repeat, rows
    may repeat, and nothing is shuffled. A null or empty text holds no item; without
    items every row stays.
    """
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index(text)
    for block in _blocks(items, item_id, item_text):
        held = spark.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, edits)
            for batch in batches:
                yield batch.filter(pa.array([not (t and matcher.find(normalised(t), True)) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(tidy(keep), docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a benchmark item in a document."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
