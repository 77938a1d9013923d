"""Streams of log events: pairs of turns as they complete, and duplicates dropped within a watermark."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIRS = "session string, seq long, user string, asst string"
STATE = "seq long, text string, usable boolean"


def stream_pairs(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(session, seq, user, asst) of a stream (session, seq, kind, text), as operators.dialogue.first_replies.

    The state of a session is its last event: a reply is paired if that was a usable user turn. Events of a
    session must arrive in order between batches; inside a batch they are ordered by seq. A session's state is kept for
    ever unless idle_ms is given: then one without events for so long is forgotten, and a reply that comes later is
    paired with nothing.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        _, user, usable = state.get if state.exists else (-1, None, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, kind, text in zip(rows["seq"], rows["kind"], rows["text"], strict=True):
            if kind == "reply" and usable:
                out.append((key[0], int(seq), user, text))
            usable, user = kind == "user", text if kind == "user" else None
        state.update((int(rows["seq"].iloc[-1]), user, bool(usable)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session", "seq", "user", "asst"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("session").applyInPandasWithState(advance, PAIRS, STATE, "append", timeout)


def stream_distinct(pairs: DataFrame, time_col: str, delay: str = "1 hour") -> DataFrame:
    """Pairs without repeats that arrive within the delay of each other."""
    return pairs.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["user", "asst"])
