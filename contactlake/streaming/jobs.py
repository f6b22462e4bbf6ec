"""Streaming contact and crawl-telemetry jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contactlake.functions import addresses as A
from contactlake.operators.extraction import extract_contact_records
from contactlake.operators.joins import lookup
from contactlake.operators.ordering import running
from contactlake.operators.suppression import _index

JOB_TIMEOUT_MS = 600_000
# State of a job or key that has been silent this long is dropped.
KEEP_STATE_MS = 7 * 86_400_000

# fixed values: event name -> job status it leads to
EVENT_STATUS = {
    "queued": "queued", "started": "running", "progress": "running", "record": "running", "crawler_error": "running",
    "done": "completed", "cancelled": "cancelled", "timeout": "failed", "error": "failed",
}
TERMINAL_EVENTS = ("done", "cancelled", "timeout", "error")


def stream_contacts(pages: DataFrame, **options) -> DataFrame:
    """Contacts as pages arrive; stateless, so any output mode and no shuffle."""
    return extract_contact_records(pages, **options)


def stream_first_seen(contacts: DataFrame, ts: str = "discovered_at", delay: str | None = None, keys=("job_id", "email")) -> DataFrame:
    """Each address once per job.

    State is one key per job and address, on disk under RocksDB.  With ``delay``
    keys are forgotten behind the watermark: bounded state, but an address that
    comes back later than that is announced again.
    """
    if delay is None:
        return contacts.dropDuplicates(list(keys))
    return contacts.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def progress(events: DataFrame, snapshot_every: int = 5) -> DataFrame:
    """Running totals per job (batch or update-mode stream).

    ``events(job_id, event)``.  A crawl announces each address once, so its
    record events count unique addresses; ``due_snapshot`` marks every fifth page.
    """
    out = events.groupBy("job_id").agg(
        F.count_if(F.col("event") == "progress").alias("pages_visited"),
        F.count_if(F.col("event") == "record").alias("unique_emails"),
        F.count_if(F.col("event") == "crawler_error").alias("errors"),
    )
    return out.withColumn("due_snapshot", F.col("pages_visited") % snapshot_every == 0)


stream_progress = progress


def sequence_events(events: DataFrame, job: str = "job_id", ts: str = "ts", tie: str = "event_id", ranges: int | None = None) -> DataFrame:
    """Batch: increasing seq per job in time order, and id 'job:seq'."""
    out = running(events, [job], [F.col(ts), F.col(tie)], row_number="seq", ranges=ranges)
    return out.withColumn("id", F.concat_ws(":", F.col(job).cast("string"), F.col("seq").cast("string")))


class _Sequencer(StatefulProcessor):
    """Numbers the events of a job across micro-batches.

    Within a micro-batch a key's rows are ordered as a whole, whatever chunks they
    come in; they are three narrow columns of one job's share of one batch.
    """

    def __init__(self, last_events: tuple[str, ...]) -> None:
        self.last_events = last_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq = self.last.get()[0] if self.last.exists() else 0
        ordered = pd.concat(rows).sort_values(["ts", "event_id"])
        yield pd.DataFrame({
            "job_id": key[0], "event_id": ordered["event_id"], "event": ordered["event"],
            "seq": range(seq + 1, seq + 1 + len(ordered)),
        })
        if ordered["event"].iloc[-1] in self.last_events:
            self.last.clear()
        else:
            self.last.update((seq + len(ordered),))

    def close(self) -> None:
        pass


def stream_sequence(events: DataFrame, last_events: tuple[str, ...] = ()) -> DataFrame:
    """Stream: events(job_id, event_id, event, ts) with a per-job arrival number.

    Arrival is by micro-batch, and by time within one.  State is one number per
    job; where jobs end for good, ``last_events`` (such as ``TERMINAL_EVENTS``)
    name the events after which it is dropped.
    """
    return events.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Sequencer(last_events),
        outputStructType="job_id bigint, event_id bigint, event string, seq bigint",
        outputMode="Append",
        timeMode="None",
    )


def replay(sequenced: DataFrame, since_seq: int = 0, job=None, keep: int | None = None) -> DataFrame:
    """Events after ``since_seq``, of each job the last ``keep`` if given."""
    scoped = sequenced if job is None else sequenced.where(F.col("job_id") == job)
    after = F.col("seq") > max(since_seq, 0)
    if keep is None:
        return scoped.where(after)
    latest = scoped.groupBy("job_id").agg(F.max("seq").alias("__top"))
    return lookup(scoped, latest, "job_id").where((F.col("seq") > F.col("__top") - keep) & after).drop("__top")


def job_state(events: DataFrame) -> DataFrame:
    """Latest status per job, and duration once it has ended (batch or stream).

    ``events(job_id, seq, event, ts)``.  The last event decides.
    """
    status = A.lookup(EVENT_STATUS, F.col("event"))
    ends = F.col("event").isin(*TERMINAL_EVENTS)
    out = events.where(status.isNotNull()).groupBy("job_id").agg(
        F.max_by(status, "seq").alias("status"),
        F.min(F.when(F.col("event") == "started", F.col("ts"))).alias("started_at"),
        F.max(F.when(ends, F.col("ts"))).alias("__ended"),
        F.count_if(F.col("event") == "progress").alias("pages"),
        F.count_if(F.col("event") == "record").alias("records"),
        F.count_if(F.col("event") == "crawler_error").alias("errors"),
    )
    terminal = F.col("status").isin("completed", "cancelled", "failed")
    return out.withColumn("ended_at", F.when(terminal, F.col("__ended"))).withColumn(
        "duration_ms", F.unix_millis("ended_at") - F.unix_millis("started_at")
    ).drop("__ended")


def job_timeouts(events: DataFrame, limit_ms: int = JOB_TIMEOUT_MS) -> DataFrame:
    """Batch: jobs whose time from start to end, or to their last event, exceeds the limit."""
    spans = events.groupBy("job_id").agg(
        F.min(F.when(F.col("event") == "started", F.unix_millis("ts"))).alias("started_ms"),
        F.min(F.when(F.col("event").isin(*TERMINAL_EVENTS), F.unix_millis("ts"))).alias("ended_ms"),
        F.max(F.unix_millis("ts")).alias("last_ms"),
    )
    ran = F.coalesce("ended_ms", "last_ms") - F.col("started_ms")
    return spans.withColumn("ran_ms", ran).where(F.col("ran_ms") > limit_ms).withColumn(
        "message", F.concat(F.lit("Job timed out after exceeding "), F.lit(limit_ms // 1000), F.lit("s limit"))
    )


class _Watchdog(StatefulProcessor):
    """Reports a job once its limit passes without a terminal event (event time)."""

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "started bigint, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, ended = self.job.get() if self.job.exists() else (None, False)
        last = 0
        for chunk in rows:
            starts = chunk.loc[chunk["event"] == "started", "ts_ms"]
            if len(starts):
                first = int(starts.min())
                started = first if started is None else min(started, first)
            ended = ended or bool(chunk["event"].isin(TERMINAL_EVENTS).any())
            last = max(last, int(chunk["ts_ms"].max()))
        self.job.update((started, ended))
        # The timer ends every state: of a job without a start once it has been silent long enough.
        self.handle.registerTimer(started + self.limit_ms if started is not None else last + KEEP_STATE_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            started, ended = self.job.get()
            if not ended and started is not None:
                yield pd.DataFrame({"job_id": [key[0]], "started_ms": [started]})
            self.job.clear()

    def close(self) -> None:
        pass


def stream_job_timeouts(events: DataFrame, limit_ms: int = JOB_TIMEOUT_MS, delay: str = "1 minute") -> DataFrame:
    """Stream: events(job_id, event, ts timestamp) -> jobs past their limit."""
    timed = events.withWatermark("ts", delay).withColumn("ts_ms", F.unix_millis("ts"))
    return timed.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Watchdog(limit_ms),
        outputStructType="job_id bigint, started_ms bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


def session_activity(events: DataFrame, ts: str = "ts", delay: str = "10 minutes", size: str = "1 hour", slide: str | None = None, keys=("event",)) -> DataFrame:
    """Counts per tumbling or sliding window, late events up to the watermark included."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    counted = events.withWatermark(ts, delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def user_sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes", key: str = "job_id") -> DataFrame:
    """Sessions per key: bursts of events closer than the gap.

    Sessions of one task merge before the shuffle (a setting in ``session``), so a
    busy key stays small.
    """
    grouped = events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def stream_suppression(contacts: DataFrame, suppression: DataFrame) -> DataFrame:
    """Flag contacts against a static list while they stream (stream-static joins)."""
    index = _index(suppression)
    e = A.normalise(F.col("email"))
    out = contacts.select(
        "*", e.alias("__k_email"), A.part(e, 1).alias("__k_domain"), F.sha2(e, 256).alias("__k_sha256"), F.md5(e).alias("__k_md5")
    )
    kinds = (("email", "email"), ("domain", "domain"), ("sha256", "hash"), ("md5", "hash"))
    for kind, space in kinds:
        side = index.where(F.col("space") == space).select(
            F.col("key").alias(f"__k_{kind}"), F.col("reason").alias(f"__r_{kind}")
        )
        out = lookup(out, side, f"__k_{kind}")
    reason = F.coalesce(*[F.col(f"__r_{k}") for k, _ in kinds])
    kind = F.coalesce(*[F.when(F.col(f"__r_{k}").isNotNull(), k) for k, _ in kinds])
    flagged = out.withColumn("is_suppressed", kind.isNotNull()).withColumn("suppression_reason", reason).withColumn("matched_type", kind)
    return flagged.drop(*[c for c in flagged.columns if c.startswith("__")])
