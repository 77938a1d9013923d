import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.dialogue import first_replies
from corpusloom.streaming import ordered

SCHEMA = "session string, seq long, kind string, text string, at timestamp"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def log(n=40):
    rng = random.Random(71)
    kinds = ["user", "reply", "reply", "bad_user", "user", "user", "reply", "bad_reply"]
    return [(f"s{s}", i, rng.choice(kinds), f"t{s}-{i}", 1_700_000_000 + 10 * i + s) for s in range(4) for i in range(n)]


def stream(spark, folder, name, batches, delay):
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "session string, seq long, kind string, text string, at long").withColumn("at", F.timestamp_seconds("at"))
        frame.coalesce(1).write.parquet(f"{folder}/in/{n:03d}")
        for file in glob.glob(f"{folder}/in/{n:03d}/*.parquet"):
            os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))  # files are read in order of their times
    events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = ordered.ordered_pairs(events, "at", delay).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").start()
    q.processAllAvailable()
    progress = [p if isinstance(p, dict) else p.jsonValue if hasattr(p, "jsonValue") else p for p in q.recentProgress]
    q.stop()
    return sorted(tuple(r) for r in spark.table(name).collect()), progress


def batch_pairs(spark, rows):
    frame = spark.createDataFrame([r[:4] for r in rows], "session string, seq long, kind string, text string")
    return sorted(tuple(r) for r in first_replies(frame, ["session"], ["seq"]).select("session", "seq", "user", "asst").collect())


def test_any_shuffling_within_the_delay_gives_the_batch_pairs(spark, rocks, tmp_path):
    rows, rng = log(), random.Random(72)
    by_arrival = sorted(rows, key=lambda r: r[4] + rng.uniform(0, 90))  # none is later than 90 seconds
    size = len(rows) // 5
    batches = [by_arrival[i : i + size] for i in range(0, len(rows), size)]
    assert any(b[k][4] > b[k + 1][4] for b in batches for k in range(len(b) - 1))
    end = [("end", 0, "user", "x", rows[-1][4] + 1000), ("end", 1, "user", "x", rows[-1][4] + 1001)]
    got, progress = stream(spark, str(tmp_path), "ordered_pairs", [*batches, end], "100 seconds")
    assert got == batch_pairs(spark, rows) and len(got) > 10
    assert ordered.late_events(progress) == 0


def test_late_events_are_counted_and_pair_with_nothing(spark, rocks, tmp_path):
    rows = [("s", 0, "user", "q", 1000), ("s", 1, "reply", "a", 1010)]
    later = [("s", 2, "user", "r", 2000)]
    late = [("s", 9, "reply", "too late", 1005), ("s", 3, "reply", "b", 2010)]
    end = [("end", 0, "user", "x", 9000)]
    more = [("t", 0, "user", "x", 2005)]  # a batch judges lateness by the watermark that the one before it began with
    got, progress = stream(spark, str(tmp_path), "late_pairs", [rows, later, more, late, end, [("end", 1, "user", "x", 9001)]], "10 seconds")
    assert got == [("s", 1, "q", "a"), ("s", 3, "r", "b")]
    assert ordered.late_events(progress) == 1
