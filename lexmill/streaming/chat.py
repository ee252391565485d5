"""Our own extension: conversation operators over a stream of messages.

The batch operators define the results; here the state of each session is kept between
micro-batches, so a follow-up borrows the last user message whenever it came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chat import is_follow_up

OUTPUT = "session_id string, seq long, retrieval_query string"


def rewritten_stream(messages: DataFrame, idle: str | None = "1 hour") -> DataFrame:
    """(session_id, seq, retrieval_query) of user messages (session_id, seq, role, content).

    Order within a session is by seq inside each micro-batch; the last user message is the only
    state, dropped after ``idle`` without a message (None: never, for sessions known to be few;
    a stream with a timeout also runs batches without input).
    """
    limit = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples():
            if r.role != "user":
                continue
            now = r.content.strip()
            out.append((key[0], r.seq, f"{last} {now}" if r.follow_up and last is not None else now))
            last = now
        if last is not None:
            state.update((last,))
            if limit:
                state.setTimeoutDuration(limit)
        yield pd.DataFrame(out, columns=["session_id", "seq", "retrieval_query"])

    told = messages.select("session_id", "seq", "role", F.coalesce("content", F.lit("")).alias("content")).withColumn("follow_up", is_follow_up(F.trim("content")))
    return told.groupBy("session_id").applyInPandasWithState(step, OUTPUT, "last string", "append", GroupStateTimeout.ProcessingTimeTimeout if limit else GroupStateTimeout.NoTimeout)


def weak_area_stream(scores: DataFrame, watermark: str = "1 day", window: str = "7 days") -> DataFrame:
    """Earned and total points by user, topic and week of (user_id, topic_id, earned, total, ts)."""
    w = F.window("ts", window)
    sums = scores.withWatermark("ts", watermark).groupBy(w, "user_id", "topic_id").agg(F.sum("earned").alias("earned"), F.sum("total").alias("total"))
    return sums.select(F.col("window.start").alias("week_start"), "user_id", "topic_id", "earned", "total", (F.col("earned") / F.col("total")).alias("ratio"))
