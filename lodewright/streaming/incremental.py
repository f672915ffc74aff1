"""The incremental operators as streams: appended turns, exactly-once by key, bursts, throttling, rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once_per_key(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once among the events that arrive within the delay of one another; state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def bursts(stream: DataFrame, key: list[str], time: str, gap: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Bursts of events, each once it has been quiet for the gap."""
    windows = stream.withWatermark(time, delay).groupBy(*key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return windows.select(*key, F.col("w.start").alias("starts_at"), F.col("w.end").alias("ends_at"), "n")


def first_per_window(stream: DataFrame, key: list[str], time: str, id_: str, width: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    windows = stream.withWatermark(time, delay).groupBy(*key, F.window(time, width).alias("w")).agg(F.min_by(id_, F.struct(time, id_)).alias(id_))
    return windows.select(*key, F.col("w.start").alias("starts_at"), id_)


def new_turns(stream: DataFrame, session: list[str], idle: str | None = None) -> DataFrame:
    """session, seq, content_hash, action of the turns that are new: past the highest seq of their session so far.

    A turn at that very seq with another hash marks a rewritten log: it comes out as rewritten, and the session must be
    read again. State is one number and one hash for each session. With idle, a duration like "30 days", it goes after idling so
    long; such a query never ends by itself.
    """
    schema = ", ".join(f"{c} {dict(stream.dtypes)[c]}" for c in session) + ", seq int, content_hash string, action string"
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark, digest = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable").drop_duplicates("seq", keep="last")
        at_mark = rows[(rows["seq"] == mark) & (rows["content_hash"] != digest)] if mark else rows.iloc[:0]
        out = [(*key, int(r.seq), r.content_hash, "rewritten") for r in at_mark.itertuples()]
        fresh = rows[rows["seq"] > mark]
        out += [(*key, int(r.seq), r.content_hash, "new") for r in fresh.itertuples()]
        if len(fresh):
            mark, digest = int(fresh["seq"].iloc[-1]), fresh["content_hash"].iloc[-1]
        elif len(at_mark):
            digest = at_mark["content_hash"].iloc[-1]
        state.update((mark, digest))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[*session, "seq", "content_hash", "action"])

    return stream.groupBy(*session).applyInPandasWithState(step, schema, "mark int, digest string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
