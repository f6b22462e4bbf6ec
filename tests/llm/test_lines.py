"""Line dedup against a count in Python; the levels of runs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from contactlake.llm import line_runs
from contactlake.operators.stored import Folder

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    split = [(r[1] or "").split("\n") for r in rows]
    counts = Counter(k for lines in split for k in {key(x) for x in lines} if k)
    out = []
    for lines in split:
        kept = [x for x in lines if counts[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def got(df):
    return Counter((r.n_lines, r.n_dropped, r.kept_text) for r in df.collect())


def test_counts_documents_across_batches(make_docs):
    rows = [(i, f"own {i}\n  Shared LINE \n\nshared line\nÉ{i % 3}\n{'x' * (i % 5)}", "en", "a") for i in range(40)]
    rows += [(100 + i, f"rare\nrow {i}", "en", "b") for i in range(9)]
    assert got(line_runs.drop_common_lines(make_docs(rows))) == brute(rows, 10)
    assert got(line_runs.drop_common_lines(make_docs(rows), min_docs=2, batches=5, fanout=2)) == brute(rows, 2)


def test_odd_rows(make_docs, odd_rows):
    out = line_runs.drop_common_lines(make_docs(odd_rows, clashing=True), min_docs=2)
    assert got(out) == brute(odd_rows, 2)
    assert {r.h1 for r in out.collect()} == {"own"}
    assert line_runs.drop_common_lines(make_docs([])).count() == 0


def test_runs_are_merged_by_level(spark, tmp_path):
    runs = line_runs.LineRuns(spark, str(tmp_path), min_docs=3, fanout=2, buckets=2)
    batch = spark.range(6).select(F.col("id").alias("h1"), F.col("id").alias("h2"))
    for _ in range(2):
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [0, 1]
    runs.add(batch)
    runs.add(batch.where("h1 < 2"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert {r.h1 for r in runs.decided().collect()} == set(range(6))
    # Decided keys are anti-joined away: a further batch adds only what is new.
    assert {r.h1 for r in runs.undecided(spark.range(4, 8).selectExpr("id as h1", "id as h2")).collect()} == {6, 7}
    # One manifest and the live runs are all that is left in the folder.
    assert len(runs.folder.names()) == 1 + len(runs.names())
    runs.drop()
    assert runs.names() == [] and not tmp_path.exists()


def test_a_store_is_opened_again(spark, make_docs, tmp_path):
    rows = [(i, f"own {i}\nShared line\nhalf {i // 12}\n{'x' * (i % 7)}", "en", "a") for i in range(60)]
    store, seen = str(tmp_path / "a store"), []
    for n, at in enumerate(range(0, 60, 20)):
        seen += rows[at : at + 20]
        line_runs.drop_common_lines(make_docs(rows[at : at + 20]), batches=2, fanout=2, store=store, batch=f"day {n}").count()
        # As in a new session: nothing but the folder is known.
        for table in spark.catalog.listTables():
            spark.sql(f"drop table {table.name}")
        once = line_runs.drop_common_lines(make_docs(seen))
        held = line_runs.LineRuns(spark, store, fanout=2)
        assert len(held.batches) == 2 * (n + 1) and max(map(len, held.levels)) < 2
        # Held batches are not counted again, and all documents are cleaned by all counts.
        for k in range(n + 1):
            again = line_runs.drop_common_lines(make_docs(rows[20 * k : 20 * k + 20]), batches=2, fanout=2, store=store, batch=f"day {k}")
            assert got(again) == got(once.where(f"doc_id between {20 * k} and {20 * k + 19}"))
    assert got(once) == brute(rows, 10)
    with pytest.raises(ValueError):
        line_runs.LineRuns(spark, store, min_docs=3)
    with pytest.raises(ValueError):
        line_runs.drop_common_lines(make_docs(rows), store=store)


@pytest.mark.parametrize("lost_at", [1, 2, 3, 4])
def test_a_lost_driver_loses_no_count(spark, tmp_path, monkeypatch, lost_at):
    """Lost before or after any move of a manifest, or while what it replaced is removed: batches are repeated and counted once."""
    batches = [spark.range(n, n + 4).selectExpr("id as h1", "id as h2") for n in range(4)]
    runs = line_runs.LineRuns(spark, str(tmp_path), min_docs=2, fanout=2, buckets=2)
    runs.add(batches[0], "0")
    moves, move, delete = [], Folder.move, Folder.delete

    def failing_move(self, source, target):
        moves.append(target)
        if len(moves) == lost_at:
            raise RuntimeError("driver lost")
        move(self, source, target)

    def failing_delete(self, name):
        if len(moves) == lost_at - 2:
            raise RuntimeError("driver lost")
        delete(self, name)

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(Folder, "move", failing_move)
        if lost_at > 2:
            m.setattr(Folder, "delete", failing_delete)
        for n, batch in enumerate(batches):
            runs.add(batch, str(n))
        raise RuntimeError("not lost")
    assert moves
    runs = line_runs.LineRuns(spark, str(tmp_path), min_docs=2, fanout=2)
    added = [runs.add(batch, str(n)) for n, batch in enumerate(batches)]
    assert not added[0] and added[-1]
    assert {r.h1 for r in runs.decided().collect()} == {1, 2, 3, 4, 5}
    assert len(runs.folder.names()) == 1 + len(runs.names())
