"""Byte-level BPE: encoding by overlapping chunks, decoding by joining raw bytes.

Every text is cut into chunks of CHUNK characters that overlap by OVERLAP. Each chunk is
pre-tokenised on its own. What the pattern matches at a place depends only on what
follows, so two chunks that both have a boundary at one place agree from there on: the
chunks are stitched at the first boundary that both have. Where an overlap has no common
boundary (a run without any boundary that is longer than the overlap), the chunks are
joined and pre-tokenised as one. Then the pieces are encoded. The chunks of a text of
more than SPREAD are dealt out over the cluster before they are pre-tokenised; those of
shorter texts stay where the text lies.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import free, hashable, packed, ship, table, tidy, unpacked

CHUNK = 4096
OVERLAP = 256
SPREAD = 8
#: Pre-tokens that a worker remembers, some 5 MB.
KNOWN = 40_000


class Vocabulary:
    """The ranks of a vocabulary file and the pattern of its pre-tokens."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        self.file, self.pattern = ranks_file, pattern

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """Reads the file on the driver; its bytes (about 1 MB) go along with the tasks."""
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def encoding(self) -> tiktoken.Encoding:
        return _encoding(self.file, self.pattern)


@lru_cache(maxsize=4)
def _encoding(ranks_file: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
    return tiktoken.Encoding("millrace", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks_of(text: str) -> list[tuple[int, str]]:
    """The overlapping chunks of a text, each with its start; an empty text is one empty chunk."""
    return [(lo, text[lo : lo + CHUNK + OVERLAP]) for lo in range(0, max(1, len(text) - OVERLAP), CHUNK)]


def boundaries(text: str, pattern: str, start: int = 0) -> np.ndarray:
    """The ends of the pre-tokens of ``text``, plus ``start``; gaps between matches end nowhere."""
    compiled = regex.compile(pattern)
    if not compiled.groups:
        ends = np.cumsum([len(x) for x in compiled.findall(text)], dtype=np.int64)
        if (ends[-1] if len(ends) else 0) == len(text):  # no gaps
            return ends + start
    return np.fromiter((m.end() for m in compiled.finditer(text)), dtype=np.int64) + start


def stitch(chunks: list[tuple[int, str, np.ndarray]], pattern: str) -> tuple[str, np.ndarray]:
    """The whole text and the boundaries of its pre-tokens.

    ``chunks``: start, text and boundaries of each, in order, each overlapping the next.
    """
    start, text, ends = chunks[0]
    texts, done = [text], []
    # tail begins with a place known to be a boundary; recent is the text from there on
    tail, recent = np.concatenate(([start], ends)), text
    end = start + len(text)
    for i, (lo, nxt, own) in enumerate(chunks[1:], 2):
        # matches that reach an artificial end, or look at what follows it, are not sure
        sure = tail[(tail >= lo) & (tail < end - 2)]
        common = np.intersect1d(sure, own[own < end - 2])
        added = nxt[end - lo :]
        texts.append(added)
        at = int(common[0]) if len(common) else int(tail[tail <= lo][-1])
        recent = recent[at - int(tail[0]) :] + added
        end += len(added)
        done.append(tail[tail < at])
        if len(common):
            tail = np.concatenate(([at], own[own > at]))
        elif (own < end - 2).any() or i == len(chunks):
            tail = np.concatenate(([at], boundaries(recent, pattern, at)))
        else:  # inside a run without boundaries: wait for its end
            tail = np.array([at])
    return "".join(texts), np.concatenate([*done, tail])[1:]


def encode_pieces(text: str, ends: np.ndarray, encoding: tiktoken.Encoding, known: dict[str, bytes]) -> bytes:
    """The ids of the pre-tokens that end at ``ends``, as little-endian unsigned 32-bit integers.

    ``known`` holds ids of short pre-tokens that occurred; as bytes they are a tenth of a list.
    """
    out: list[bytes] = []
    at = 0
    for end in ends.tolist():
        piece = text[at:end]
        at = end
        ids = known.get(piece)
        if ids is None:
            ids = np.array(encoding.encode_ordinary(piece), dtype="<u4").tobytes()  # a pre-token alone is one match of the pattern
            if len(known) < KNOWN and len(piece) < 32:
                known[piece] = ids
        out.append(ids)
    return b"".join(out)


def bytes_of(ids: bytes, encoding: tiktoken.Encoding) -> bytes:
    """The bytes of the tokens of ``ids``, joined."""
    return encoding.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with ``ids``: its texts' token ids as little-endian unsigned 32-bit integers (binary).

    A null or empty text gives no ids (empty binary). All columns pass through, texts
    included; repeated rows stay repeated. A column named like ``ids`` is replaced.
    Texts of up to SPREAD chunks are encoded where they lie; only longer ones move, equal
    rows of them once. A row, its text and its ids must fit a task.

    With a name ``decoded`` the ids are decoded again at once, as ``decode`` does: one
    Python worker a task, where ``decode`` after ``encode`` keeps two.
    """
    new = [ids, decoded] if decoded else [ids]
    df = free(df, new)
    ship(df.sparkSession)
    at = df.columns.index(text)
    pattern = vocabulary.pattern
    own = F.col(f"`{text}`")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, known = vocabulary.encoding(), {}

        def one(value: str) -> bytes:
            whole, ends = stitch([(lo, x, boundaries(x, pattern, lo)) for lo, x in chunks_of(value)], pattern)
            return encode_pieces(whole, ends, encoding, known)

        for held in batches:
            for lo in range(0, held.num_rows, 256):
                batch = held.slice(lo, 256)
                found = [one(x or "") for x in batch.column(at).to_pylist()]
                back = [pa.array([bytes_of(x, encoding) for x in found], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary()), *back], [*batch.schema.names, *new])

    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.BinaryType()) for c in new]])
    is_long = F.coalesce(F.length(own) > SPREAD * CHUNK + OVERLAP, F.lit(False))
    encoded = df.where(~is_long).mapInArrow(tidy(near), schema)

    # a long text travels as chunks under the digest of its row; the row itself goes with the first one
    rest = [c for c in df.columns if c != text]
    digest = [F.xxhash64(F.lit(i), *hashable(df)).alias(f"h{i}") for i in range(2)]
    single = df.where(is_long).select(*digest, F.struct(own.alias("part"), packed(df.select(*[f"`{c}`" for c in rest])).alias("rest")).alias("row")) if rest else None
    if single is None:
        single = df.where(is_long).select(*digest, F.struct(own.alias("part"), F.struct(F.lit(None).cast("int").alias("c0")).alias("rest")).alias("row"))
    counted = single.groupBy("h0", "h1").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n")).select("h0", "h1", F.col("row.part").alias("part"), F.struct("n", F.col("row.rest").alias("rest")).alias("kept"))
    names = ["h0", "h1", "lo", "part", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                starts, parts = zip(*chunks_of(batch.column(2)[i].as_py()))
                same = pa.array([i] * len(starts))
                first = pa.array([i] + [None] * (len(starts) - 1), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(starts, pa.int64()), pa.array(parts), batch.column(3).take(first)], names)

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [boundaries(x, pattern, lo).astype("<i8").tobytes() for lo, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.binary())], [*names, "ends"])

    def join(chunks):
        chunks = chunks.sort_by("lo")
        rows = zip(*(chunks.column(c).to_pylist() for c in ("lo", "part", "ends")))
        whole, ends = stitch([(lo, x, np.frombuffer(e, dtype="<i8")) for lo, x, e in rows], pattern)
        encoding = vocabulary.encoding()
        found = encode_pieces(whole, ends, encoding, {})
        back = {"decoded": pa.array([bytes_of(found, encoding)], pa.binary())} if decoded else {}
        return pa.table({"kept": chunks.column("kept").slice(0, 1), "part": [whole], "ids": pa.array([found], pa.binary())} | back)

    part, kept = (T.StructField(f.name, f.dataType) for f in counted.schema.fields[2:])  # nullable: later chunks have no rest
    key = [T.StructField("h0", T.LongType()), T.StructField("h1", T.LongType())]
    chunked = T.StructType([*key, T.StructField("lo", T.LongType()), part, kept])
    dealt = counted.mapInArrow(cut, chunked).repartition("h0", "h1", "lo")
    joined = dealt.mapInArrow(pretokenise, T.StructType([*chunked.fields, T.StructField("ends", T.BinaryType())])).groupBy("h0", "h1").applyInArrow(join, T.StructType([kept, part, *[T.StructField(c, T.BinaryType()) for c in ("ids", "decoded")[: len(new)]]]))
    again = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("kept.n"))))
    others = dict(zip(rest, unpacked(rest, "kept.rest")))
    out = again.select(*[F.col("part").alias(c) if c == text else others[c] for c in df.columns], *[F.col(c).alias(name) for c, name in zip(("ids", "decoded"), new)])
    return encoded.unionByName(out)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``decoded``: the bytes of the tokens of ``ids``, joined.

    Bytes are not checked to be UTF-8, as a token may hold part of a character. Null ids
    give no bytes; an id that the vocabulary lacks is an error. Other columns and repeated
    rows pass through; a column named like ``decoded`` is replaced.
    """
    df = free(df, [decoded])
    ship(df.sparkSession)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary.encoding()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                found = [bytes_of(x or b"", encoding) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, decoded])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())]))


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    vocabulary = public_vocabulary()
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "ids")
    return decode(ids, vocabulary).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
