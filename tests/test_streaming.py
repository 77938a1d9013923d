from corpusloom.operators.dialogue import first_replies
from corpusloom.streaming.sessions import stream_distinct, stream_pairs


def test_stream_is_the_batch(spark, tmp_path):
    kinds = ["user", "reply", "reply", "bad_user", "reply", "user", "user", "reply", "bad_reply", "user", "reply"]
    rows = [(f"s{s}", i, kinds[(i + s) % len(kinds)], f"t{i}") for s in range(5) for i in range(30)]
    frame = spark.createDataFrame(rows, "session string, seq long, kind string, text string")
    for part in range(3):
        frame.where(f"seq div 10 = {part}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_pairs(stream).writeStream.format("memory").queryName("pairs").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("pairs").collect())
    batch = first_replies(frame, ["session"], ["seq"]).select("session", "seq", "user", "asst").collect()
    assert got == sorted(tuple(r) for r in batch) and got


def test_stream_with_forgetting_pairs_the_same_while_sessions_go_on(spark, tmp_path):
    frame = spark.createDataFrame([("s", 0, "user", "q"), ("s", 1, "reply", "a")], "session string, seq long, kind string, text string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stream_pairs(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), idle_ms=3_600_000)
    q = q.writeStream.format("memory").queryName("pairs_idle").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    assert [tuple(r) for r in spark.table("pairs_idle").collect()] == [("s", 1, "q", "a")]


def test_stream_distinct(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "q", "a"), ("2024-01-01 00:01:00", "q", "a"), ("2024-01-01 00:02:00", "q", "b")]
    frame = spark.createDataFrame(rows, "at string, user string, asst string").selectExpr("cast(at as timestamp) at", "user", "asst")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stream_distinct(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), "at")
    q = stream.writeStream.format("memory").queryName("distinct_pairs").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.user, r.asst) for r in spark.table("distinct_pairs").collect()) == [("q", "a"), ("q", "b")]
