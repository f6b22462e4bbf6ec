import random

import pytest
from pyspark.sql import functions as F

from contactlake.operators.extraction import extract_contact_records
from contactlake.plans import seeds
from contactlake.streaming import jobs as J
from contactlake.streaming import quotas as Q
from contactlake.streaming.runner import ROCKSDB, run_append, stream_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def requests(seed=3, n=400):
    """A key with most of the traffic, bursts at one instant, and long silences."""
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 1, 7, 30, 400])
        rows.append((1 if rng.random() < 0.7 else rng.randrange(2, 6), t, i, rng.randrange(0, 9)))
    return rows


def fixed_windows(rows, limit, window):
    state, out = {}, {}
    for key, t, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        count, expires = state.get(key, (0, -1))
        if count == 0 or t > expires:
            count, expires = 0, t + window
        state[key] = (count + 1, expires)
        out[i] = (count + 1, count + 1 <= limit, expires - t)
    return out


@pytest.mark.parametrize("window", [5, 100, 3000])
def test_request_quota_matches_the_counter(spark, window):
    rows = requests()
    df = spark.createDataFrame(rows, "key long, t long, id long, n long")
    got = {r.id: (r.used, r.allowed, r.reset_ms) for r in Q.request_quota(df.drop("n"), 4, window, ranges=4).collect()}
    assert got == fixed_windows(rows, 4, window)


def test_stream_quota_matches_the_counter(spark, tmp_path):
    rows = requests()
    spark.createDataFrame(rows, "key long, t long, id long, n long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, t long, id long, n long").parquet(str(tmp_path / "in"))
    out = run_append(Q.stream_request_quota(stream, 4, 100), str(tmp_path / "out"))
    want = fixed_windows(rows, 4, 100)
    assert {r.id: (r.used, r.allowed) for r in out.collect()} == {i: w[:2] for i, w in want.items()}


def test_stream_quota_orders_a_large_key_over_batches(spark, tmp_path):
    """12,000 requests of one key, stored newest first, in three files of rising time."""
    rows = [(1, 10_000_000 + i * 3, i, 0) for i in range(12_000)]
    schema = "key long, t long, id long, n long"
    for part in range(3):
        mine = [r for r in rows if r[2] // 4000 == part][::-1]
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_append(Q.stream_request_quota(stream, 50, 1000, delay="1 hour"), str(tmp_path / "out"))
    want = fixed_windows(rows, 50, 1000)
    assert {r.id: (r.used, r.allowed) for r in out.collect()} == {i: w[:2] for i, w in want.items()}


def test_first_seen_once_per_job_whatever_the_gap(spark, tmp_path):
    for hour in range(0, 21, 3):
        rows = [(1, "a@b.com", f"2024-01-01 {hour:02d}:00:00"), (hour, "a@b.com", f"2024-01-01 {hour:02d}:00:00")]
        df = spark.createDataFrame(rows, "job_id long, email string, ts string").selectExpr("job_id", "email", "timestamp(ts) as discovered_at")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id long, email string, discovered_at timestamp").option("maxFilesPerTrigger", 1)
    out = run_append(J.stream_first_seen(stream.parquet(str(tmp_path / "in"))), str(tmp_path / "out"))
    assert sorted(r.job_id for r in out.collect()) == [0, 1, 3, 6, 9, 12, 15, 18]


def test_stream_sequence_over_batches(spark, tmp_path):
    schema = "job_id long, event_id long, event string, ts timestamp"
    for part in range(2):
        rows = [(1, part * 6000 + i, "progress") for i in range(6000)][::-1] + [(2, 90_000 + part, "done")]
        df = spark.createDataFrame(rows, "job_id long, event_id long, event string").selectExpr("*", "timestamp_seconds(event_id) as ts")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_append(J.stream_sequence(read()), str(tmp_path / "out"))
    assert {r.event_id: r.seq for r in out.where("job_id = 1").collect()} == {i: i + 1 for i in range(12_000)}
    assert sorted(r.seq for r in out.where("job_id = 2").collect()) == [1, 2]
    ended = run_append(J.stream_sequence(read(), J.TERMINAL_EVENTS), str(tmp_path / "ended"))
    assert [r.seq for r in ended.where("job_id = 2").collect()] == [1, 1]


def test_stream_extraction_equals_batch(spark):
    cols = ["page_id", "email", "context_type", "phone"]
    pages = "/root/testdata/sf0.01"
    batch = extract_contact_records(spark.read.parquet(f"{pages}/pages.parquet"), discovered_at=F.lit("x")).select(*cols)
    live = run_append(J.stream_contacts(stream_table(spark, pages, "pages"), discovered_at=F.lit("x")).select(*cols))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect())) != []


def test_stream_reads_a_table_of_part_files(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    spark.range(100, 120).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    live = run_append(stream_table(spark, str(tmp_path), "pages"), str(tmp_path / "out"))
    assert sorted(r.id for r in live.collect()) == list(range(100))


def test_sequence_and_replay(spark):
    rows = [("j", 10, "a"), ("j", 20, "b"), ("j", 30, "c"), ("k", 5, "x")]
    df = spark.createDataFrame([(j, e, i, F_ts) for i, (j, F_ts, e) in enumerate(rows)], "job_id string, event string, event_id int, ts int")
    seq = J.sequence_events(df)
    assert {r.id for r in seq.collect()} == {"j:1", "j:2", "j:3", "k:1"}
    assert sorted(r.event for r in J.replay(seq, since_seq=1, job="j").collect()) == ["b", "c"]
    assert sorted(r.event for r in J.replay(seq, keep=1).collect()) == ["c", "x"]


def test_stream_sequence_has_no_gaps(spark):
    stream = seeds.crawl_events(stream_table(spark, SF, "events"))
    out = run_append(J.stream_sequence(stream)).groupBy("job_id").agg(
        F.count("*").alias("n"), F.max("seq").alias("top"), F.count_distinct("seq").alias("d")
    )
    assert out.count() > 0 and out.where("n <> top or n <> d").count() == 0


def test_job_state(spark):
    rows = [("a", 1, "started", 0), ("a", 2, "record", 1), ("a", 3, "done", 5), ("b", 1, "queued", 0), ("b", 2, "started", 2), ("c", 1, "started", 1), ("c", 2, "timeout", 9)]
    df = spark.createDataFrame(rows, "job_id string, seq int, event string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.job_id: (r.status, r.duration_ms, r.records) for r in J.job_state(df).collect()}
    assert got == {"a": ("completed", 5000, 1), "b": ("running", None, 0), "c": ("failed", 8000, 0)}


def test_timeouts(spark, tmp_path):
    rows = [(1, "started", 0), (1, "done", 60), (2, "started", 10), (2, "progress", 700), (3, "started", 5000), (9, "progress", 4000)]
    df = spark.createDataFrame(rows, "job_id long, event string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    assert [(r.job_id, r.ran_ms) for r in J.job_timeouts(df).collect()] == [(2, 690_000)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert [r.job_id for r in run_append(J.stream_job_timeouts(stream), str(tmp_path / "out")).collect()] == [2]


def test_late_events_are_dropped_behind_the_watermark(spark, tmp_path):
    def part(name, seconds):
        spark.createDataFrame([("e", s) for s in seconds], "event string, s long").select(
            "event", F.timestamp_seconds("s").alias("ts")
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("event string, ts timestamp").parquet(str(tmp_path / "in"))
        return run_append(J.session_activity(stream, size="1 minute", delay="10 seconds"), str(tmp_path / "out"))

    part("a", [0, 5, 59, 300])
    assert [(r.n) for r in run().orderBy("window_start").collect()] == [3]
    part("b", [1, 2, 700])
    assert [(r.n) for r in run().orderBy("window_start").collect()] == [3, 1]
