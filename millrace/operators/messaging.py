"""Conversations, members, messages, receipts and reactions.

Frames: conversations (id, type, title, avatar_url, course_id, created_at,
last_message_at), members (conversation_id, user_id), messages (id, conversation_id,
sender_id, content, deleted_for_everyone, replied_to_msg_id, ...), receipts
(conversation_id, user_id, last_message_id), reactions (message_id, user_id, emoji,
created_at), users (id, full_name). What a service would look up row by row is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.crypto import decrypted


def conversations_of(conversations: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """The conversations that a user is a member of."""
    mine = members.where(F.col("user_id") == user_id).select(F.col("conversation_id").alias("id"))
    return conversations.join(mine, "id")


def search(conversations: DataFrame, members: DataFrame, users: DataFrame, user_id: int, query: str | None) -> DataFrame:
    """A user's conversations whose title (groups) or partner's name (direct ones) is like ``query``; all of them without one."""
    mine = conversations_of(conversations, members, user_id)
    if not query:
        return mine
    like = F.lit(f"%{query}%")
    partners = (
        members.where(F.col("user_id") != user_id)
        .join(users.where(F.col("full_name").ilike(f"%{query}%")).select(F.col("id").alias("user_id")), "user_id", "left_semi")
        .select(F.col("conversation_id").alias("id"), F.lit(True).alias("__named"))
        .distinct()
    )
    words = F.to_json("title") if isinstance(mine.schema["title"].dataType, T.MapType) else F.col("title")
    title = F.when(F.col("type") == "GROUP", F.call_function("ilike", words, like))
    return mine.join(partners, "id", "left").where(F.coalesce(title, F.lit(False)) | ((F.col("type") == "DIRECT") & F.coalesce("__named", F.lit(False)))).drop("__named")


def by_activity() -> list[Column]:
    """Newest first; conversations without any time come first, then by id."""
    return [F.coalesce("last_message_at", "created_at").desc_nulls_first(), F.col("id").asc()]


def direct_between(conversations: DataFrame, members: DataFrame, one: int, other: int) -> DataFrame:
    """Direct conversations that both users are members of."""
    has = lambda u: members.where(F.col("user_id") == u).select(F.col("conversation_id").alias("id"))
    return conversations.where(F.col("type") == "DIRECT").join(has(one), "id", "left_semi").join(has(other), "id", "left_semi")


def direct_partners(conversations: DataFrame, members: DataFrame, caller: int) -> DataFrame:
    """Users in a direct conversation with the caller; one row a shared conversation."""
    direct = conversations.where(F.col("type") == "DIRECT").select(F.col("id").alias("conversation_id"))
    mine = members.where(F.col("user_id") == caller).select("conversation_id")
    return members.where(F.col("user_id") != caller).join(direct, "conversation_id", "left_semi").join(mine, "conversation_id", "left_semi").select("user_id")


def contacts(candidates: DataFrame, partners: DataFrame, users: DataFrame, caller: int, query: str | None = None) -> DataFrame:
    """Candidates (position, user_id, role) that are not yet partners, each once with its first role, by name."""
    first = candidates.where(F.col("user_id").isNotNull() & (F.col("user_id") != caller)).groupBy("user_id").agg(F.min_by("role", "position").alias("role"), F.min("position").alias("position"))
    left = first.join(partners, "user_id", "left_anti").join(users.select(F.col("id").alias("user_id"), "full_name"), "user_id", "left")
    wanted = (query or "").strip().lower()
    return left.where(F.contains(F.lower("full_name"), F.lit(wanted))) if wanted else left


def unread(messages: DataFrame, members: DataFrame, receipts: DataFrame, user_id: int) -> DataFrame:
    """A user's unread messages: of others, not deleted, after the last one read; without a receipt all of them.

    Receipts are unique by conversation and user, so a left join keeps the count; the
    user's own members and receipts are few next to messages.
    """
    mine = members.where(F.col("user_id") == user_id).select("conversation_id")
    read = receipts.where(F.col("user_id") == user_id).select("conversation_id", "last_message_id")
    others = messages.where((F.col("sender_id") != user_id) & ~F.col("deleted_for_everyone"))
    return others.join(mine.join(read, "conversation_id", "left"), "conversation_id").where(F.col("id") > F.coalesce("last_message_id", F.lit(0)))


def unread_total(messages: DataFrame, members: DataFrame, receipts: DataFrame, user_id: int) -> DataFrame:
    return unread(messages, members, receipts, user_id).agg(F.count(F.lit(1)).alias("total"))


def unread_counts(messages: DataFrame, members: DataFrame, receipts: DataFrame, user_id: int) -> DataFrame:
    """By conversation; those without unread messages do not appear."""
    return unread(messages, members, receipts, user_id).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("unread_count"))


def last_messages(messages: DataFrame, columns: list[str]) -> DataFrame:
    """The newest message of each conversation, by id: an aggregate with partial results, no window."""
    newest = messages.groupBy("conversation_id").agg(F.max_by(F.struct(*columns), "id").alias("m"))
    return newest.select("conversation_id", *[F.col(f"m.{c}").alias(c) for c in columns])


def newest_page(messages: DataFrame, conversation_id: int, page: int, size: int) -> DataFrame:
    """One page counted from the newest message, shown oldest first."""
    own = messages.where(F.col("conversation_id") == conversation_id)
    return own.orderBy(F.col("id").desc()).offset(page * size).limit(size).orderBy(F.col("id").asc())


def with_replies(messages: DataFrame, preview: list[str]) -> DataFrame:
    """Each message with ``replied_to``, the fields of the message it answers; null where that is gone."""
    parent = messages.select(F.col("id").alias("__parent"), F.struct("id", *preview).alias("replied_to"))
    return messages.join(parent, F.col("replied_to_msg_id") == F.col("__parent"), "left").drop("__parent")


def readable(content: Column, key: Column, deleted: Column) -> Column:
    """The decrypted content, null where the message is deleted or cannot be read."""
    return F.when(~deleted, decrypted(content, key))


def soft_deleted(messages: DataFrame, message_id: int, user_id: int) -> DataFrame:
    """The messages with one of the user's own turned into a tombstone."""
    hit = (F.col("id") == message_id) & (F.col("sender_id") == user_id)
    return messages.withColumns({"deleted_for_everyone": F.when(hit, F.lit(True)).otherwise(F.col("deleted_for_everyone")), "content": F.when(~hit, F.col("content"))})


def reaction_summary(reactions: DataFrame, me: int | None) -> DataFrame:
    """By message and emoji: how many, whether ``me`` is among them, and ``rank``, the order of first reactions."""
    mine = F.coalesce(F.bool_or(F.col("user_id") == me), F.lit(False)) if me is not None else F.lit(False)
    found = reactions.groupBy("message_id", "emoji").agg(F.count(F.lit(1)).alias("n"), mine.alias("reacted_by_me"), F.min("created_at").alias("first_at"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("message_id").orderBy("first_at", "emoji")))


def with_reactions(messages: DataFrame, summary: DataFrame) -> DataFrame:
    """Messages with their reactions as a list in display order, empty where there is none."""
    lists = summary.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("rank", "emoji", "n", "reacted_by_me"))).alias("reactions"))
    joined = messages.join(lists.withColumnRenamed("message_id", "id"), "id", "left")
    return joined.withColumn("reactions", F.coalesce("reactions", F.array()))


def avatar(kind: Column, course_id: Column, own: Column, of_course: Column, of_partner: Column) -> Column:
    """A course's picture for its group, the group's own one, or the partner's."""
    return F.when(kind == "GROUP", F.when(course_id.isNotNull(), of_course).otherwise(own)).otherwise(of_partner)


def summaries(conversations: DataFrame, members: DataFrame, messages: DataFrame, users: DataFrame, courses: DataFrame, caller: int) -> DataFrame:
    """A user's conversations as they are answered: participants with names, last message, avatar.

    users (id, full_name, avatar_url) and courses (id, avatar_url) are dimensions.
    """
    people = members.join(users.select(F.col("id").alias("user_id"), "full_name", F.col("avatar_url").alias("user_avatar")), "user_id", "left")
    held = people.groupBy("conversation_id").agg(
        F.array_sort(F.collect_list(F.struct("user_id", "full_name"))).alias("participants"),
        F.min_by("user_avatar", F.when(F.col("user_id") != caller, F.col("user_id"))).alias("partner_avatar"),
    )
    last = last_messages(messages, ["id", "sender_id"]).select(F.col("conversation_id"), F.struct("id", "sender_id").alias("last_message"))
    mine = conversations_of(conversations, members, caller)
    wide = mine.join(held.withColumnRenamed("conversation_id", "id"), "id", "left").join(last.withColumnRenamed("conversation_id", "id"), "id", "left")
    wide = wide.join(courses.select(F.col("id").alias("course_id"), F.col("avatar_url").alias("course_avatar")), "course_id", "left")
    return wide.withColumn("avatar", avatar(F.col("type"), F.col("course_id"), F.col("avatar_url"), F.col("course_avatar"), F.col("partner_avatar"))).drop("course_avatar", "partner_avatar")


def media_access(files: DataFrame, messages: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """The files (file_name) that a member of a conversation may see through a message that links them."""
    linked = messages.where(~F.col("deleted_for_everyone") & F.col("media_url").isNotNull()).select(F.regexp_extract("media_url", r"([^/]+)$", 1).alias("file_name"), "conversation_id")
    mine = members.where(F.col("user_id") == user_id).select("conversation_id")
    return files.join(linked.join(mine, "conversation_id", "left_semi").select("file_name").distinct(), "file_name", "left_semi")
