"""Erasure and retention rewrite only what they have to."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from contactlake.operators import stored


def files(path):
    return {
        os.path.relpath(os.path.join(d, n), path): os.stat(os.path.join(d, n)).st_mtime_ns
        for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")
    }


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "a store")
    rows = spark.range(400).selectExpr("id", "concat('U', id, '@x.com') as email", "cast(id % 5 as string) as team", "if(id = 7, null, id) as n")
    rows.repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(path)
    return path


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def test_only_touched_files_change(spark, store):
    before = files(store)
    out = stored.erase_from_files(spark, store, keys(spark, "u3@x.com", "u4@x.com", "u390@x.com", "none@x.com", None), F.lower("email")).collect()
    assert sorted(r.deleted_rows for r in out) == [1, 2]
    after = files(store)
    assert {n: t for n, t in before.items() if after.get(n) == t} == {n: t for n, t in before.items() if n in after}
    assert len(set(before) - set(after)) == 2
    left = sorted(r.id for r in spark.read.parquet(store).collect())
    assert left == [i for i in range(400) if i not in (3, 4, 390)]
    again = files(store)
    assert stored.erase_from_files(spark, store, keys(spark, "u3@x.com"), F.lower("email")).collect() == []
    assert files(store) == again


def test_partitioned_folders(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(60).selectExpr("id", "concat('u', id) as email", "id % 3 as team", "concat('k ', id % 2) as kind").repartition(1).write.partitionBy("team", "kind").parquet(path)
    stored.erase_from_files(spark, path, keys(spark, "u0", "u7", *[f"u{i}" for i in range(1, 60, 6)]), F.col("email"))
    left = {(r.id, r.team, r.kind) for r in spark.read.parquet(path).collect()}
    assert left == {(i, i % 3, f"k {i % 2}") for i in range(60) if i not in (0, 7) and i % 6 != 1}


def test_interrupted_runs_are_finished_or_dropped(spark, store, monkeypatch):
    before = files(store)

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(stored, "_apply", lost)
        with pytest.raises(RuntimeError):
            stored.erase_from_files(spark, store, keys(spark, "u1@x.com"), F.lower("email"))
    assert files(store).items() >= before.items() and spark.read.parquet(store).count() == 400
    with monkeypatch.context() as m:
        m.setattr(stored.Folder, "delete", lost)
        with pytest.raises(RuntimeError):
            stored.finish_erasures(spark, store)
    assert stored.finish_erasures(spark, store) == 1
    assert spark.read.parquet(store).where("id = 1").isEmpty() and spark.read.parquet(store).count() == 399
    with monkeypatch.context() as m:
        m.setattr(stored.Folder, "write", lost)
        with pytest.raises(RuntimeError):
            stored.erase_from_files(spark, store, keys(spark, "u2@x.com"), F.lower("email"))
    assert stored.finish_erasures(spark, store) == 1 and spark.read.parquet(store).count() == 399
    assert not [n for n in os.listdir(store) if n.startswith("_erasing")]


def test_retention_drops_days_unread(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = spark.range(24 * 6).selectExpr("id", "timestamp '2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int)) as ts")
    rows.withColumn("day", F.to_date("ts")).repartition(1).write.partitionBy("day").parquet(path)
    os.makedirs(os.path.join(path, "day=__HIVE_DEFAULT_PARTITION__"))
    for name in os.listdir(os.path.join(path, "day=2024-03-01")):  # never opened
        os.truncate(os.path.join(path, "day=2024-03-01", name), 3)
    before = files(path)
    out = stored.retain_since(spark, path, datetime(2024, 3, 3, 10))
    assert (out.dropped, out.rewritten) == ([date(2024, 3, 1), date(2024, 3, 2)], [date(2024, 3, 3)])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(58, 144))
    after = files(path)
    assert all(after[n] == t for n, t in before.items() if n >= "day=2024-03-04")
    assert stored.retain_since(spark, path, datetime(2024, 3, 3, 10)) == stored.Retained()
    assert stored.retain_since(spark, path, datetime(2024, 3, 3, 23, 30)).dropped == [date(2024, 3, 3)]
    assert stored.retain_since(spark, path, datetime(2024, 3, 5)).dropped == [date(2024, 3, 4)]
