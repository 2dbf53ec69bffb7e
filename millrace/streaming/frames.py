"""Frames of a live channel: parsed, dispatched, fanned out, counted, kept as state.

Everything but ``toggled``, ``receipts`` and ``unread_to_push`` takes streaming and batch
frames alike. Sessions, receipts and unread counts are aggregates by key, so that a stream
(in update mode) keeps one row of state a key and gives out the keys that changed.
Reactions keep their state by a function of its own and have a batch twin, an ordered fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.text import one_of

PAYLOAD = "struct<conversationId:bigint,content:string,type:string,mediaUrl:string,mediaType:string,repliedToMessageId:bigint,senderId:bigint>"
#: Bytes that may wait for one session.
SEND_BUFFER = 128 * 1024
MESSAGE_TYPES = ["TEXT", "IMAGE", "VIDEO", "FILE", "AUDIO"]


def parsed(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON text as (type, payload); what does not parse has a null type."""
    return raw.select(F.from_json(value, f"struct<type:string,payload:{PAYLOAD}>").alias("f")).select(F.upper("f.type").alias("type"), "f.payload")


def messages(frames: DataFrame) -> DataFrame:
    """Message frames as rows; an unknown message type is TEXT."""
    p = F.col("payload")
    return frames.where(F.col("type") == "MESSAGE").select(
        p["conversationId"].alias("conversation_id"), p["senderId"].alias("sender_id"), p["content"].alias("content"), one_of(p["type"], MESSAGE_TYPES, "TEXT").alias("type"), p["repliedToMessageId"].alias("replied_to_msg_id")
    )


def calls(frames: DataFrame) -> DataFrame:
    p = F.col("payload")
    return frames.where(F.col("type") == "CALL").select(p["conversationId"].alias("conversation_id"), p["senderId"].alias("sender_id"), p["content"].alias("content"))


def unknown(frames: DataFrame) -> DataFrame:
    return frames.where(~F.coalesce(F.col("type").isin("MESSAGE", "CALL"), F.lit(False)))


def fan_out(rows: DataFrame, members: DataFrame, to_sender: bool = True) -> DataFrame:
    """One row for each member of a row's conversation; messages also go to the sender, calls do not."""
    people = members.select("conversation_id", F.col("user_id").alias("recipient_id"))
    out = rows.join(people, "conversation_id")
    return out if to_sender else out.where(F.col("recipient_id") != F.col("sender_id"))


def unread(sent: DataFrame, members: DataFrame, receipts: DataFrame) -> DataFrame:
    """(user_id, conversation_id, unread) for every member that messages of others reach.

    sent: conversation_id, sender_id, id, deleted_for_everyone; receipts: conversation_id,
    user_id, last_message_id, unique by the first two. What is deleted or read counts as 0.
    """
    reached = fan_out(sent, members, to_sender=False).withColumnRenamed("recipient_id", "user_id")
    read = receipts.select("conversation_id", "user_id", "last_message_id")
    fresh = ~F.col("deleted_for_everyone") & (F.col("id") > F.coalesce("last_message_id", F.lit(0)))
    return reached.join(read, ["conversation_id", "user_id"], "left").groupBy("user_id", "conversation_id").agg(F.count_if(fresh).alias("unread"))


def unread_to_push(counts: DataFrame, changed: DataFrame) -> DataFrame:
    """What each user in ``changed`` (user_id) is sent: the total and the counts of all its conversations that have any."""
    own = counts.join(changed.select("user_id").distinct(), "user_id", "left_semi")
    some = F.filter(F.array_sort(F.collect_list(F.struct("conversation_id", "unread"))), lambda c: c["unread"] > 0)
    return own.groupBy("user_id").agg(F.sum("unread").alias("total"), F.map_from_entries(some).alias("by_conversation"))


def overflowing(sent: DataFrame, limit: int = SEND_BUFFER) -> DataFrame:
    """Recipients of a batch (recipient_id, value) whose frames together outgrow a session's buffer; their sessions are closed."""
    return sent.groupBy("recipient_id").agg(F.sum(F.octet_length("value")).alias("bytes")).where(F.col("bytes") > limit)


def toggled(events: DataFrame, order: Column) -> DataFrame:
    """(message_id, user_id, emoji) after all events: the same emoji again removes it, another one replaces it."""
    listed = events.groupBy("message_id", "user_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "emoji"))).alias("e"))
    last = F.aggregate("e", F.lit(None).cast("string"), lambda s, x: F.when(~x["emoji"].eqNullSafe(s), x["emoji"]))
    return listed.select("message_id", "user_id", last.alias("emoji")).where("emoji IS NOT NULL")


def toggle_stream(events: DataFrame) -> DataFrame:
    """Changes of state, by message and user: (message_id, user_id, seq, emoji), a null emoji for a removal.

    ``events``: message_id, user_id, seq, emoji. State is one emoji a key. What is left of
    a batch depends on its last run of equal emojis: they cancel each other in pairs, and
    only a run that is the whole batch meets the state.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        emoji = rows["emoji"].iloc[-1]
        others = (rows["emoji"] != emoji).to_numpy().nonzero()[0]
        run = len(rows) - 1 - others[-1] if len(others) else len(rows) + (emoji == now)
        now = emoji if run % 2 and not pd.isna(emoji) else None
        if now is None:
            if state.exists:
                state.remove()
        else:
            state.update((now,))
        yield pd.DataFrame({"message_id": [key[0]], "user_id": [key[1]], "seq": [rows["seq"].max()], "emoji": pd.Series([now], dtype="object")})

    return events.groupBy("message_id", "user_id").applyInPandasWithState(fold, "message_id long, user_id long, seq long, emoji string", "emoji string", "append", GroupStateTimeout.NoTimeout)


def session_changes(events: DataFrame, order: Column) -> DataFrame:
    """(user_id, session): the last to open, or null after any close, even that of an older session."""
    last = events.groupBy("user_id").agg(F.max_by(F.struct("kind", "session"), order).alias("e"))
    return last.select("user_id", F.when(F.col("e.kind") == "OPEN", F.col("e.session")).alias("session"))


def sessions(events: DataFrame, order: Column) -> DataFrame:
    """(user_id, session): the open ones, one a user."""
    return session_changes(events, order).where(F.col("session").isNotNull())


def receipt_changes(events: DataFrame, newest: DataFrame, order: Column) -> DataFrame:
    """(conversation_id, user_id, last_message_id): the last write wins, even backwards; a null id means the newest message.

    newest: conversation_id, newest_id.
    """
    last = events.groupBy("conversation_id", "user_id").agg(F.max_by(F.struct("last_message_id"), order).alias("e")).join(newest, "conversation_id", "left")
    return last.select("conversation_id", "user_id", F.coalesce("e.last_message_id", "newest_id").alias("last_message_id"))


def receipts(state: DataFrame, events: DataFrame, newest: DataFrame, order: Column) -> DataFrame:
    """Read receipts (conversation_id, user_id, last_message_id) after a batch of writes."""
    keys = ["conversation_id", "user_id"]
    new = receipt_changes(events, newest, order)
    return state.join(new.select(*keys), keys, "left_anti").unionByName(new)


def personal(reactions: DataFrame, members: DataFrame) -> DataFrame:
    """Reaction summaries for every member: conversation_id, recipient_id, message_id, emoji, n, reacted_by_me.

    reactions: conversation_id, message_id, user_id, emoji. Counts are taken once, before
    they are multiplied by members.
    """
    counted = reactions.groupBy("conversation_id", "message_id", "emoji").agg(F.count(F.lit(1)).alias("n"))
    mine = reactions.select("message_id", "emoji", F.col("user_id").alias("recipient_id"), F.lit(True).alias("reacted_by_me")).distinct()
    sent = fan_out(counted, members)
    return sent.join(mine, ["message_id", "emoji", "recipient_id"], "left").withColumn("reacted_by_me", F.coalesce("reacted_by_me", F.lit(False)))


def into_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append"):
    """Runs ``each`` on what has arrived, in bounded batches, then stops; the checkpoint makes it go on where it was."""
    return stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
