"""Request and usage quotas whose windows open with a key's first request."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contactlake.operators.ordering import running
from contactlake.session import ensure_checkpoint_dir


def _window_starts(ticks: DataFrame, window_ms: int, ranges: int | None) -> DataFrame:
    """(key, anchor): ticks at which a window opens.

    The first tick of a key opens one; each next window opens at the first tick
    after the previous one expired.  That chain is followed by pointer doubling:
    a number of joins that grows with the logarithm of the windows per key.
    """
    step = F.col("at")
    marks = ticks.select("key", F.col("t").alias("at"), F.lit(1).alias("is_tick"), "t").unionByName(
        ticks.select("key", (F.col("t") + window_ms).alias("at"), F.lit(0).alias("is_tick"), "t")
    )
    # Going back in time, the smallest tick seen before an expiry mark is the next opening.
    seen = running(
        marks, ["key"], [step.desc(), F.col("is_tick"), F.col("t")],
        maxima={"neg": F.when(F.col("is_tick") == 1, -F.col("at"))}, ranges=ranges,
    )
    jumps = seen.where((F.col("is_tick") == 0) & F.col("neg").isNotNull()).select("key", "t", (-F.col("neg")).alias("nxt"))
    first = ticks.groupBy("key").agg(F.min("t").alias("t"))
    # Only first ticks and jump targets can ever open a window.
    nodes = jumps.select("key", F.col("nxt").alias("t")).unionByName(first).distinct()
    jumps = jumps.join(nodes, ["key", "t"], "left_semi").checkpoint(eager=True)
    reached = first.checkpoint(eager=True)
    while True:
        fresh = reached.join(jumps, ["key", "t"]).select("key", F.col("nxt").alias("t"))
        grown = reached.unionByName(fresh).distinct().checkpoint(eager=True)
        if grown.count() == reached.count():
            return reached.withColumnRenamed("t", "anchor")
        reached = grown
        far = jumps.select("key", F.col("t").alias("nxt"), F.col("nxt").alias("far"))
        jumps = jumps.join(far, ["key", "nxt"]).select("key", "t", F.col("far").alias("nxt")).checkpoint(eager=True)


def request_quota(events: DataFrame, limit: int, window_ms: int, ranges: int | None = None) -> DataFrame:
    """Batch: each request's count in its window, verdict, remaining and reset.

    ``events(key, t, id)`` with t in milliseconds.
    """
    ensure_checkpoint_dir(events.sparkSession)
    ticks = events.select("key", "t").distinct().checkpoint(eager=True)
    anchors = _window_starts(ticks, window_ms, ranges)
    opened = ticks.join(anchors.select("key", F.col("anchor").alias("t"), F.col("anchor")), ["key", "t"], "left")
    placed = running(opened, ["key"], [F.col("t")], maxima={"window_start": F.col("anchor")}, ranges=ranges)
    joined = events.join(placed.select("key", "t", "window_start"), ["key", "t"])
    out = running(joined, ["key", "window_start"], [F.col("t"), F.col("id")], row_number="used", ranges=ranges)
    return (
        out.withColumn("allowed", F.col("used") <= limit)
        .withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))
        .withColumn("reset_ms", F.col("window_start") + window_ms - F.col("t"))
    )


def tumbling_quota(events: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """Epoch-aligned variant: requests per key and window, and how many were refused."""
    start = F.floor(F.col("t") / window_ms) * window_ms
    out = events.groupBy("key", start.alias("window_start")).agg(F.count("*").alias("used"))
    return out.withColumn("refused", F.greatest(F.lit(0), F.col("used") - limit))


class _Counter(StatefulProcessor):
    """Fixed-window counter; the window opens with the first request after expiry."""

    def __init__(self, limit: int, window_ms: int, timed: bool) -> None:
        self.limit, self.window_ms, self.timed = limit, window_ms, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "count bigint, expires bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, expires = self.state.get() if self.state.exists() else (0, -1)
        # A key's rows of a micro-batch are ordered as a whole: two narrow columns.
        batch = pd.concat(rows).sort_values(["t", "id"])
        times, used = batch["t"].to_numpy(), np.empty(len(batch), np.int64)
        at = 0
        while at < len(times):
            if count == 0 or times[at] > expires:
                count, expires = 0, int(times[at]) + self.window_ms
            stop = int(np.searchsorted(times, expires, side="right"))
            stop = max(stop, at + 1)
            used[at:stop] = np.arange(count + 1, count + 1 + stop - at)
            count, at = count + stop - at, stop
        yield pd.DataFrame({"key": key[0], "id": batch["id"], "used": used, "allowed": used <= self.limit})
        self.state.update((count, expires))
        if self.timed:
            self.handle.registerTimer(expires + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # An earlier window's timer leaves a later window alone.
        if self.state.exists() and self.state.get()[1] < expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_request_quota(events: DataFrame, limit: int, window_ms: int, delay: str | None = None) -> DataFrame:
    """Stream: the same arithmetic in arrival order, state per key.

    Arrival is by micro-batch, and by time within one: a request that comes in a
    later batch than a newer one is counted after it.  State is two numbers per
    key; with ``delay`` it is dropped once the watermark has passed its window, and
    requests that come later than that are not answered.
    """
    if delay:
        events = events.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", delay)
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Counter(limit, window_ms, bool(delay)),
        outputStructType="key bigint, id bigint, used bigint, allowed boolean",
        outputMode="Append",
        timeMode="EventTime" if delay else "None",
    )
