"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of the documents they got. Columns with the name of an
operator's result do no harm: a row travels as a struct through the operators. Null and
empty texts fall at the first stage; an empty table stays empty through all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, linededup, quality, simhash
from millrace.llm.common import forget, hashable, packed, saved, table, unpacked, written

#: No SQL: the stages hash with XXH64, measure edit distances and encode by byte pairs; tests hold them against brute force.
ORACLE_SQL: str | None = None


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the whole row as ``row``, so that no column can clash with an operator's results."""
    return docs.select("doc_id", "text", packed(docs).alias("row"))


def _with_text(found: DataFrame, columns: list[str]) -> DataFrame:
    """The rows again, with the text of ``found`` and its length."""
    return found.select(*unpacked(columns, "row", {"text": F.col("text"), "n_chars": F.length("text").cast("long")}))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines."""
    judged = quality.clean(_carried(docs)).where("kept")
    return _with_text(judged.select("row", F.col("clean_text").alias("text")), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, and documents of which nothing is left. A null text stays null."""
    left = linededup.drop_recurring(_carried(docs))
    return _with_text(left.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest id stays, once; rows without an id come last.

    Linked are sets of five-word shingles with a similarity of 0.8 or more, exactly. Rows
    are told apart by a 64-bit digest of all columns, so that unlike texts of one id stay,
    and of a row that is there several times one.
    """
    since = written()
    held = docs.select(packed(docs).alias("row"), F.xxhash64(*hashable(docs)).alias("key"), F.col("doc_id").alias("id"), "text")
    rows = held.groupBy("key").agg(F.first("id").alias("id"))
    found = simhash.alike(held, simhash.Plan.candidates(), "key").join(rows, "key")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key"))
    stay = saved(found.groupBy("component").agg(first.alias("r")).select("r.key"), "stay")
    forget(spark, since, 1)
    # equal rows become one in each task before anything moves; the join then finds them where they lie
    return held.select("key", "row").dropDuplicates(["key"]).join(stay, "key", "left_semi").select(*unpacked(docs.columns, "row"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go; a null text holds none."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and whether decoding them gives its bytes back."""
    vocabulary = bpe.public_vocabulary()
    coded = bpe.encode(docs.select("doc_id", "text"), vocabulary, decoded="decoded")  # one worker a task
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.col("ids"),
        F.sha2("ids", 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written to the shared folder and read again.

    What a stage wrote on its way, and what it read, is deleted once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    since = written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
            forget(spark, since, 1)
    return docs
