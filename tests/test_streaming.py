"""Streams give what their batch twins give."""

from pyspark.sql import functions as F

from millrace.streaming import frames, runs


def test_parsing(spark):
    raw = spark.createDataFrame([('{"type":"message","payload":{"conversationId":1,"type":"video","senderId":2}}',), ('{"type":"CALL","payload":{"conversationId":1,"senderId":2}}',), ("nonsense",), ('{"type":"x"}',)], "value string")
    p = frames.parsed(raw)
    assert [r["type"] for r in frames.messages(p).collect()] == ["VIDEO"]
    assert frames.calls(p).count() == 1 and frames.unknown(p).count() == 2
    members = spark.createDataFrame([(1, 2), (1, 3)], "conversation_id long, user_id long")
    assert frames.fan_out(frames.messages(p), members).count() == 2
    assert [r["recipient_id"] for r in frames.fan_out(frames.calls(p), members, to_sender=False).collect()] == [3]


def test_toggle_fold(spark):
    e = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "a", 2), (1, 1, "b", 3), (1, 2, "a", 1), (1, 2, "a", 2), (2, 1, "c", 1), (2, 1, "d", 2)], "message_id long, user_id long, emoji string, o int")
    assert sorted(tuple(r) for r in frames.toggled(e, F.col("o")).collect()) == [(1, 1, "b"), (2, 1, "d")]


def test_toggle_over_several_batches(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, n, em) for n, em in enumerate("aabbbca")], "message_id long, user_id long, seq long, emoji string")
    for n in range(7):
        e.where(F.col("seq") == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = runs.drained(frames.toggle_stream(stream), lambda b: b)
    last = out.groupBy("message_id", "user_id").agg(F.max_by(F.struct("emoji"), "seq").alias("s")).select("s.emoji").first()
    want = frames.toggled(e.withColumn("o", F.col("seq")), F.col("o")).select("emoji").first()
    assert last[0] == want[0] == "a"


def test_sessions_and_receipts(spark):
    e = spark.createDataFrame([(1, "OPEN", 10, 1), (1, "OPEN", 11, 2), (2, "OPEN", 12, 1), (2, "OPEN", 13, 2), (2, "CLOSE", 12, 3)], "user_id int, kind string, session int, o int")
    assert [tuple(r) for r in frames.sessions(e, F.col("o")).collect()] == [(1, 11)]
    now = spark.createDataFrame([(1, 1, 5), (2, 1, 6)], "conversation_id int, user_id int, last_message_id int")
    writes = spark.createDataFrame([(1, 1, 9, 1), (1, 1, 3, 2), (3, 1, None, 1)], "conversation_id int, user_id int, last_message_id int, o int")
    newest = spark.createDataFrame([(3, 77)], "conversation_id int, newest_id int")
    assert sorted(tuple(r) for r in frames.receipts(now, writes, newest, F.col("o")).collect()) == [(1, 1, 3), (2, 1, 6), (3, 1, 77)]


def test_keyed_state_over_several_batches(spark, tmp_path):
    e = spark.createDataFrame([(1, "OPEN", 10, 1), (2, "OPEN", 12, 2), (1, "OPEN", 11, 3), (2, "CLOSE", 12, 4), (3, "OPEN", 14, 5)], "user_id int, kind string, session int, o int")
    for n in range(1, 6):
        e.where(F.col("o") == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = runs.drained(frames.session_changes(stream, F.col("o")), lambda b: b, "update")
    assert out.select("batch").distinct().count() == 5
    left = runs._last(out, "user_id").where("session IS NOT NULL")
    assert sorted(tuple(r) for r in left.collect()) == sorted(tuple(r) for r in frames.sessions(e, F.col("o")).collect()) == [(1, 11), (3, 14)]


def test_unread_pushes_hold_all_counts_of_a_member(spark, tmp_path):
    sent = spark.createDataFrame([(1, 1, 1, False), (2, 2, 2, False), (1, 1, 3, False), (1, 2, 4, True)], "conversation_id long, sender_id long, id long, deleted_for_everyone boolean")
    for n in range(1, 5):
        sent.where(F.col("id") == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2), (2, 3)], "conversation_id long, user_id long")
    read = spark.createDataFrame([(1, 2, 1)], "conversation_id long, user_id long, last_message_id long")
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = runs.pushed(frames.unread(stream, members, read))
    got = sorted((r["batch"], r["user_id"], r["total"], sorted(r["by_conversation"].items())) for r in out.collect())
    assert got == [
        (0, 2, 0, []), (0, 3, 1, [(1, 1)]),
        (1, 3, 2, [(1, 1), (2, 1)]),
        (2, 2, 1, [(1, 1)]), (2, 3, 3, [(1, 2), (2, 1)]),
        (3, 1, 0, []), (3, 3, 3, [(1, 2), (2, 1)]),
    ]


def test_sessions_whose_buffer_overflows(spark):
    sent = spark.createDataFrame([(1, "x" * 70_000), (1, "é" * 40_000), (2, "x" * 131_072)], "recipient_id int, value string")
    assert [tuple(r) for r in frames.overflowing(sent).collect()] == [(1, 150_000)]
