"""Pairs of turns from log events that arrive in any order within a delay."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PAIRS = "session string, seq long, user string, asst string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PairInOrder(StatefulProcessor):
    """Holds a session's events until the watermark has passed them, then pairs them in order of (time, seq)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, seq long, kind string, text string")
        self.last = handle.getValueState("last", "text string, usable boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if len(frame):
                self.waiting.appendList([(int(m), int(s), k, t) for m, s, k, t in zip(frame["ms"], frame["seq"], frame["kind"], frame["text"], strict=True)])
                # a time is over when the watermark reaches the millisecond after it
                for ms in sorted({int(m) + 1 for m in frame["ms"]} - set(self.handle.listTimers())):
                    self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] < over]
        text, usable = self.last.get() if self.last.exists() else (None, False)
        out = []
        for _, seq, kind, said in ready:
            if kind == "reply" and usable:
                out.append((key[0], seq, text, said))
            usable, text = kind == "user", said if kind == "user" else None
        if ready:
            self.last.update((text, bool(usable)))
            left = rows[len(ready) :]
            self.waiting.put(left) if left else self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["session", "seq", "user", "asst"])


def ordered_pairs(events: DataFrame, time_col: str, delay: str) -> DataFrame:
    """(session, seq, user, asst) of a stream (session, seq, kind, text, time), as operators.dialogue.first_replies in order of (time, seq).

    Events may come in any order and in any batch as long as none is later than the delay, so any shuffling of a log
    within it gives the batch's pairs. Later ones are dropped and counted by the query's progress
    (late_events()). A session's state is the events that the watermark has not passed and the last one that it
    has; a pair comes out when it has passed its reply. State is kept by RocksDB: set
    spark.sql.streaming.stateStore.providerClass to ROCKS. Events without a session, time or seq are left out.
    """
    known = events.where(F.col("session").isNotNull() & F.col("seq").isNotNull() & F.col(time_col).isNotNull())
    marked = known.withWatermark(time_col, delay).withColumn("ms", F.unix_millis(time_col))
    return marked.groupBy("session").transformWithStateInPandas(PairInOrder(), PAIRS, "append", "eventTime")


def late_events(progress: list) -> int:
    """How many rows a query's progress reports as dropped because the watermark had passed them."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in progress for s in p["stateOperators"])
