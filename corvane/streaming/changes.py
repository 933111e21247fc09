"""Change streams: relevance, debounce, coalesced rebuilds and sliding sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from corvane.sources.languages import detect
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery


def relevant(events: DataFrame, output: str = "", cache_dir: str = "") -> DataFrame:
    """Events (path, ...) of files with a language, but the output, the cache and hidden components. Batch or stream."""
    path = F.col("path")
    keep = detect(path).isNotNull() & ~path.rlike("(^|/)[.][^./]")
    if output:
        keep = keep & (path != output)
    if cache_dir:
        keep = keep & ~F.startswith(path, F.lit(f"{cache_dir.rstrip('/')}/"))
    return events.where(keep)


def debounce(events: DataFrame, gap: str = "300 milliseconds", late: str | None = None) -> DataFrame:
    """(start, stop, events) of bursts of (key, ts) with no pause of `gap`; `late` is a stream's watermark."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events")


def sessions_batch(events: DataFrame, gap_seconds: int) -> DataFrame:
    """The same bursts by gaps and islands, as one window a key."""
    order = Window.partitionBy("key").orderBy("ts")
    prior = F.lag("ts").over(order)
    new = F.when(prior.isNull() | (F.col("ts") >= prior + F.make_interval(secs=F.lit(gap_seconds))), 1).otherwise(0)
    return events.withColumn("n", new).withColumn("island", F.sum("n").over(order)).groupBy("key", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("events"))


def coalesce(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """One rebuild for each micro-batch, however many changes it holds; a failed rebuild leaves the offsets where they were.

    `rebuild` gets the batch's distinct paths. Other kinds of events belong to a query of their own, so none is lost.
    """

    def once(batch: DataFrame, number: int) -> None:
        paths = batch.select("path").distinct()
        if not paths.isEmpty():
            rebuild(paths, number)

    w = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(once)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def session_ttl(requests: DataFrame, ttl_seconds: int = 3600, refresh_seconds: int = 60) -> DataFrame:
    """(key, ts, valid) of a stream of (key, ts): a key is valid within the time from its last refresh.

    The first request opens the session; a valid one refreshes it if the last refresh is old enough; an
    expired one opens a new session. State of a key times out by event time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else None
        out = []
        for ts in sorted(t for f in frames for t in f["ts"]):
            now = ts.timestamp()
            valid = seen is not None and now - seen < ttl_seconds
            if not valid or now - seen >= refresh_seconds:
                seen = now
            out.append((key[0], ts, valid))
        state.update((seen,))
        state.setTimeoutTimestamp(max(int((seen + ttl_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "valid"])

    stamped = requests.withWatermark("ts", f"{ttl_seconds} seconds")
    return stamped.groupBy("key").applyInPandasWithState(step, "key bigint, ts timestamp, valid boolean", "seen double", "append", "EventTimeTimeout")
