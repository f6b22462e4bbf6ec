"""Registered streaming queries (R1-R11): each stream runs over what is available, then its sink is read."""

from pyspark.sql import functions as F

from contactlake.plans import seeds as S
from contactlake.plans.q_extract import _RECORDS
from contactlake.plans.registry import query
from contactlake.streaming import jobs as J
from contactlake.streaming import quotas as Q
from contactlake.streaming.runner import ROCKSDB, STATE_STORE, run_append, run_update, stream_table


def _event_stream(spark, sf):
    return S.crawl_events(stream_table(spark, sf, "events"))


def _stateful(spark):
    """Sessions built elsewhere may lack the state store that these processors need (see ``session``)."""
    if spark.conf.get(STATE_STORE, None) != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)


@query("r1_stream_contacts", f"with {_RECORDS} select page_id, email, context_type from records")
def r1(spark, sf):
    found = J.stream_contacts(stream_table(spark, sf, "pages"), discovered_at=F.lit("x"))
    return run_append(found.select("page_id", "email", "context_type"))


@query("r2_stream_first_seen", "select distinct user_id as job_id, event_type || '@corp.com' as email from events")
def r2(spark, sf):
    raw = stream_table(spark, sf, "events").selectExpr("user_id as job_id", "concat(event_type, '@corp.com') as email", "cast(ts as timestamp) as discovered_at")
    return run_append(J.stream_first_seen(raw)).select("job_id", "email")


@query(
    "r3_stream_progress",
    f"""with {S.EVENTS_CTE} select job_id, (count(*) filter (where event = 'progress'))::bigint as pages_visited, (count(*) filter (where event = 'record'))::bigint as unique_emails,
    (count(*) filter (where event = 'crawler_error'))::bigint as errors, ((count(*) filter (where event = 'progress')) % 5 = 0)::int as due_snapshot from ev group by 1""",
)
def r3(spark, sf):
    out = run_update(J.stream_progress(_event_stream(spark, sf)), ["job_id"])
    return out.withColumn("due_snapshot", F.col("due_snapshot").cast("int"))


_SEQ = "sq as (select *, row_number() over (partition by job_id order by ts, event_id) as seq from ev)"


@query("r4_sequence_events", f"with {S.EVENTS_CTE}, {_SEQ} select job_id, event_id, seq::bigint as seq, job_id || ':' || seq as id from sq")
def r4(spark, sf):
    return J.sequence_events(S.events(spark, sf)).select("job_id", "event_id", "seq", "id")


@query("r4_stream_sequence", f"with {S.EVENTS_CTE} select job_id, count(*)::bigint as n, 1::bigint as first_seq, count(*)::bigint as last_seq, count(*)::bigint as distinct_seqs from ev group by 1")
def r4_stream(spark, sf):
    """Arrival numbers of the stateful stream: complete and without gaps per job."""
    _stateful(spark)
    out = run_append(J.stream_sequence(_event_stream(spark, sf)))
    return out.groupBy("job_id").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_distinct("seq").alias("distinct_seqs")
    )


@query(
    "r5_replay",
    f"""with {S.EVENTS_CTE}, {_SEQ}, tp as (select job_id, max(seq) as top from sq group by 1) select sq.job_id, event_id, seq::bigint as seq from sq join tp on sq.job_id = tp.job_id
    where seq > top - 20 and seq > 15""",
)
def r5(spark, sf):
    return J.replay(J.sequence_events(S.events(spark, sf)), since_seq=15, keep=20).select("job_id", "event_id", "seq")


_STATE = f"""with {S.EVENTS_CTE}, {_SEQ}, st as (select job_id, arg_max(event, seq) as e, min(case when event = 'started' then ts end) as s, max(case when event = 'done' then ts end) as d,
    count(*) filter (where event = 'progress') as pages, count(*) filter (where event = 'record') as records, count(*) filter (where event = 'crawler_error') as errors from sq group by 1)
    select job_id, case when e = 'done' then 'completed' else 'running' end as status, coalesce((epoch_us(s) // 1000), -1)::bigint as started_ms,
    coalesce(case when e = 'done' then (epoch_us(d) // 1000) - (epoch_us(s) // 1000) end, -1)::bigint as duration_ms, pages::bigint as pages, records::bigint as records, errors::bigint as errors from st"""


def _state_columns(out):
    return out.select(
        "job_id", "status", F.coalesce(F.unix_millis("started_at"), F.lit(-1)).cast("bigint").alias("started_ms"),
        F.coalesce("duration_ms", F.lit(-1)).cast("bigint").alias("duration_ms"), "pages", "records", "errors",
    )


@query("r6_job_state", _STATE)
def r6(spark, sf):
    return _state_columns(J.job_state(J.sequence_events(S.events(spark, sf))))


@query("r6_stream_job_state", _STATE)
def r6_stream(spark, sf):
    """Update-mode stream; event ids grow with time, so they serve as order."""
    events = _event_stream(spark, sf).withColumn("seq", F.struct("ts", "event_id"))
    return _state_columns(run_update(J.job_state(events), ["job_id"]))


_DAY = 86_400_000
_LIMIT = 24 * 3600 * 1000


@query(
    "r7_job_timeouts",
    f"""with {S.EVENTS_CTE}, sp as (select job_id, (epoch_us(min(ts) filter (where event = 'started')) // 1000) as s, (epoch_us(min(ts) filter (where event = 'done')) // 1000) as d, (epoch_us(max(ts)) // 1000) as l from ev group by 1)
    select job_id, s::bigint as started_ms, (coalesce(d, l) - s)::bigint as ran_ms, 'Job timed out after exceeding {_LIMIT // 1000}s limit' as message from sp where coalesce(d, l) - s > {_LIMIT}""",
)
def r7(spark, sf):
    return J.job_timeouts(S.events(spark, sf), limit_ms=_LIMIT).select("job_id", "started_ms", "ran_ms", "message")


@query(
    "r7_stream_timeouts",
    f"""with {S.EVENTS_CTE}, live as (select job_id, ts, case when event = 'done' and job_id % 2 = 1 then 'progress' else event end as event from ev),
    sp as (select job_id, epoch_us(min(ts) filter (where event = 'started')) // 1000 as s, bool_or(event = 'done') as ended from live group by 1)
    select job_id, s::bigint as started_ms from sp where not ended and s + 600000 <= (select epoch_us(max(ts)) // 1000 from live) - 60000""",
)
def r7_stream(spark, sf):
    """Stateful watchdog with event-time timers over the jobs that never finish."""
    _stateful(spark)
    unfinished = (F.col("event") == "done") & (F.col("job_id") % 2 == 1)
    events = _event_stream(spark, sf).withColumn("event", F.when(unfinished, "progress").otherwise(F.col("event")))
    return run_append(J.stream_job_timeouts(events))


_WINDOWS = f"""with recursive q as (select user_id as key, (epoch_us(ts) // 1000) as t, event_id as id from events),
    a(key, anchor) as (select key, min(t) from q group by 1 union all
      select q.key, min(q.t) from a join q on a.key = q.key and q.t > a.anchor + {_DAY} group by q.key, a.anchor),
    w as (select q.*, (select max(anchor) from a where a.key = q.key and a.anchor <= q.t) as ws from q),
    n as (select *, row_number() over (partition by key, ws order by t, id) as used from w)"""


@query(
    "r8_request_quota",
    f"""{_WINDOWS} select key, id, used::bigint as used, (used <= 3)::int as allowed, greatest(0, 3 - used)::bigint as remaining, (ws + {_DAY} - t)::bigint as reset_ms from n""",
)
def r8(spark, sf):
    rows = S.events(spark, sf).select(F.col("job_id").alias("key"), F.unix_millis("ts").alias("t"), F.col("event_id").alias("id"))
    out = Q.request_quota(rows, limit=3, window_ms=_DAY)
    return out.select("key", "id", "used", F.col("allowed").cast("int").alias("allowed"), "remaining", "reset_ms")


@query("r8_stream_quota", f"{_WINDOWS} select key, id, used::bigint as used, (used <= 3)::int as allowed from n")
def r8_stream(spark, sf):
    """The stateful form in arrival order."""
    _stateful(spark)
    rows = _event_stream(spark, sf).select(F.col("job_id").alias("key"), F.unix_millis("ts").alias("t"), F.col("event_id").alias("id"))
    out = run_append(Q.stream_request_quota(rows, limit=3, window_ms=_DAY))
    return out.withColumn("allowed", F.col("allowed").cast("int"))


@query(
    "r8_tumbling_quota",
    f"""select user_id as key, ((epoch_us(ts) // 1000) // {_DAY} * {_DAY})::bigint as window_start, count(*)::bigint as used, greatest(0, count(*) - 3)::bigint as refused from events group by 1, 2""",
)
def r8_tumbling(spark, sf):
    rows = S.events(spark, sf).select(F.col("job_id").alias("key"), F.unix_millis("ts").alias("t"))
    return Q.tumbling_quota(rows, limit=3, window_ms=_DAY)


@query(
    "r10_session_activity",
    f"""with {S.EVENTS_CTE} select (epoch_us(time_bucket(interval 6 hours, ts)) // 1000)::bigint as start_ms, event, count(*)::bigint as n from ev
    group by 1, 2 having max(1) = 1 and (epoch_us(time_bucket(interval 6 hours, min(ts))) // 1000) + 21600000 <= (select (epoch_us(max(ts)) // 1000) from ev) - 600000""",
)
def r10(spark, sf):
    """Tumbling windows closed by the watermark."""
    out = run_append(J.session_activity(_event_stream(spark, sf), size="6 hours"))
    return out.select(F.unix_millis("window_start").alias("start_ms"), "event", "n")


@query(
    "r10_user_sessions",
    f"""with {S.EVENTS_CTE}, g as (select *, case when ts >= lag(ts) over (partition by job_id order by ts) + interval 4 hours or lag(ts) over (partition by job_id order by ts) is null then 1 else 0 end as b from ev),
    n as (select *, sum(b) over (partition by job_id order by ts rows unbounded preceding) as sid from g) select job_id, (epoch_us(min(ts)) // 1000)::bigint as start_ms, count(*)::bigint as n from n group by job_id, sid""",
)
def r10_sessions(spark, sf):
    out = J.user_sessions(S.events(spark, sf), gap="4 hours")
    return out.select("job_id", F.unix_millis("session_start").alias("start_ms"), "n")


@query(
    "r11_stream_suppression",
    """select event_id, (event_type = 'click' or user_id % 10 = 3)::int as is_suppressed, case when user_id % 10 = 3 then 'email' when event_type = 'click' then 'domain' else '' end as matched_type from events""",
)
def r11(spark, sf):
    raw = stream_table(spark, sf, "events").selectExpr("event_id", "concat('U', user_id, '@', event_type, '.com') as email")
    users = spark.read.parquet(f"{sf}/events.parquet").where("user_id % 10 = 3")
    entries = users.selectExpr("concat('e', user_id, event_type) as id", "'email' as type", "concat('u', user_id, '@', event_type, '.com') as value", "'BOUNCE' as reason").distinct()
    domain = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'click'").selectExpr("'d' as id", "'domain' as type", "concat(event_type, '.com') as value", "'MANUAL' as reason").distinct()
    out = run_append(J.stream_suppression(raw, entries.unionByName(domain)).select("event_id", "is_suppressed", "matched_type"))
    return out.select("event_id", F.col("is_suppressed").cast("int").alias("is_suppressed"), F.coalesce("matched_type", F.lit("")).alias("matched_type"))
