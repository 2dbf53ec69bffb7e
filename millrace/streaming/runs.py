"""Bounded runs of the streams over tables: started, drained, and read back.

A run writes its batches to a folder below the shared checkpoint folder, each batch to
its own place, so that a batch repeated after a failure replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.state import upserted
from millrace.streaming import frames


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session on one machine that names none gets a folder of its own, on a cluster that is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "/tmp/millrace-checkpoints"
    return place.rstrip("/")


def drained(stream: DataFrame, each: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """All batches of ``stream`` through ``each``, as a frame with the number of the ``batch``."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    frames.into_batches(stream, f"{place}/checkpoint", write, mode).awaitTermination()
    return spark.read.parquet(f"{place}/out")


def pushed(counts: DataFrame) -> DataFrame:
    """What the stream ``counts`` (see ``frames.unread``) makes a server send, with the number of the ``batch``.

    The stream gives the counts that changed; those of all keys are a table with a version
    a batch, made of the one before, so that a batch repeated after a failure gives the
    same again. Messages of earlier batches are not read again.
    """
    spark, keys = counts.sparkSession, ["user_id", "conversation_id"]
    place = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        now = f"{place}/counts/batch={number}"
        batch.persist()
        known = upserted(spark.read.schema(batch.schema).parquet(f"{place}/counts/batch={number - 1}"), batch, keys) if number else batch
        known.write.mode("overwrite").parquet(now)
        frames.unread_to_push(spark.read.schema(batch.schema).parquet(now), batch).write.mode("overwrite").parquet(f"{place}/out/batch={number}")
        batch.unpersist()

    frames.into_batches(counts, f"{place}/checkpoint", write, "update").awaitTermination()
    return spark.read.parquet(f"{place}/out")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # a pattern, as a table may be one file or a folder of files
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/{name}.parque[t]")


def _sent(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a stream of JSON frames; odd messages ring as well."""
    c = _stream(spark, d, "conversations")
    sender = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    payload = F.struct(F.col("conv_id").alias("conversationId"), F.col("text").alias("content"), sender.alias("senderId"), (F.col("conv_id") * 100 + F.col("turn")).alias("repliedToMessageId"))
    kinds = F.when((F.col("conv_id") * 100 + F.col("turn")) % 2 == 1, F.array(F.lit("message"), F.lit("CALL"))).otherwise(F.array(F.lit("message")))
    return c.select(F.explode(kinds).alias("type"), payload.alias("payload")).select(F.to_json(F.struct("type", "payload")).alias("value"))


def _counted(out: DataFrame) -> DataFrame:
    return out.groupBy("recipient_id").agg(F.count(F.lit(1)).alias("n"))


def fan_out_run(spark: SparkSession, d: str, members: DataFrame) -> DataFrame:
    return _counted(drained(frames.parsed(_sent(spark, d)), lambda b: frames.fan_out(frames.messages(b), members).select("recipient_id", "conversation_id")))


def call_run(spark: SparkSession, d: str, members: DataFrame) -> DataFrame:
    return _counted(drained(frames.parsed(_sent(spark, d)), lambda b: frames.fan_out(frames.calls(b), members, to_sender=False).select("recipient_id", "conversation_id")))


def unread_run(spark: SparkSession, d: str, shapes) -> DataFrame:
    """The last counts pushed to each member: its total, and a row for each conversation with unread messages."""
    sent = frames.messages(frames.parsed(_sent(spark, d)))
    turn = F.col("replied_to_msg_id") - F.col("conversation_id") * 100
    saved = sent.select("conversation_id", "sender_id", F.col("replied_to_msg_id").alias("id"), ((F.col("conversation_id") + turn) % 7 == 0).alias("deleted_for_everyone"))
    out = pushed(frames.unread(saved, shapes.members, shapes.receipts))
    last = out.groupBy("user_id").agg(F.max_by(F.struct("total", "by_conversation"), "batch").alias("p"))
    return last.select("user_id", "p.total", F.explode_outer("p.by_conversation").alias("conversation_id", "unread"))


def toggle_run(spark: SparkSession, d: str) -> DataFrame:
    e = _stream(spark, d, "events").select((F.col("event_id") % 50).alias("message_id"), "user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("emoji"))
    out = drained(frames.toggle_stream(e), lambda b: b)
    return out.groupBy("message_id", "user_id").agg(F.max_by(F.struct("emoji"), "seq").alias("s")).select("message_id", "user_id", "s.emoji").where("emoji IS NOT NULL")


def session_run(spark: SparkSession, d: str) -> DataFrame:
    """The sessions that are open at the end; a click closes."""
    e = _stream(spark, d, "events").select("user_id", F.when(F.col("event_type") == "click", "CLOSE").otherwise("OPEN").alias("kind"), F.col("event_id").alias("session"))
    return _last(drained(frames.session_changes(e, F.col("session")), lambda b: b, "update"), "user_id").where("session IS NOT NULL")


def receipt_run(spark: SparkSession, d: str, newest: DataFrame) -> DataFrame:
    """The receipts at the end: every message has its reader write the one before, or nothing."""
    c = _stream(spark, d, "conversations")
    at = F.col("conv_id") * 100 + F.col("turn")
    e = c.select(F.col("conv_id").alias("conversation_id"), F.lit(1).cast("long").alias("user_id"), F.when(at % 2 == 0, at - 1).alias("last_message_id"), at.alias("o"))
    return _last(drained(frames.receipt_changes(e, newest, F.col("o")), lambda b: b, "update"), "conversation_id", "user_id").select("conversation_id", "last_message_id")


def _last(out: DataFrame, *keys: str) -> DataFrame:
    """The row of the last batch for each key."""
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
