"""The stored index and the counts per day against the plain operators."""

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from contactlake.operators import daily_counts, search_index
from contactlake.operators import datasets as A

FIELDS = ["email", "domain", "name", "page_title", "context_snippet", "source_url", "type", "mx_status"]
SCHEMA = "contact_id long, " + ", ".join(f"{f} string" for f in FIELDS)


def make_contacts(n=600, seed=5):
    pick = random.Random(seed)
    words = ["Ärzte", "team", "Überblick", "doe", "😀ok", "(x)", "a.b", "50%", "sales", "İx"]
    rows = []
    for i in range(n):
        domain = pick.choice(["gmail.com", "corp.de", None, "", f"d{i}.org"])
        text = [" ".join(pick.choices(words, k=pick.randint(0, 6))) if pick.random() < 0.9 else None for _ in range(4)]
        rows.append((i, f"{pick.choice(words[1:4])}{i}@{domain}", domain, *text[:3], text[3], pick.choice(["personal", "role"]), pick.choice(["deliverable", None])))
    rows[17] = (17, "needle@corp.de", "corp.de", "Haystack Zyx", None, "", None, "role", None)
    return rows


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "an index")
    rows = spark.createDataFrame(make_contacts(), SCHEMA)
    assert search_index.add_to_index(rows.where("contact_id < 400"), path, "old", block_rows=25)
    assert search_index.add_to_index(rows.where("contact_id >= 400"), path, "new_1", block_rows=25)
    assert search_index.add_to_index(rows.where("false"), path, "3", block_rows=25)
    return rows, path


QUERIES = ["team", "TEAM", "d", "oe", "ärz", "😀", "😀O", "(x)", "a.b", "50%", " team", "zyx", "not there", "@", "b 50% sales", "i̇x", "", "  ", None]


@pytest.mark.parametrize("fields", sorted(A.SEARCH_FIELDS))
def test_rows_are_those_of_the_scan(spark, index, fields):
    rows, path = index
    # One job for all queries on either side.
    def found(search):
        parts = [search(q).select(F.lit(n).alias("q"), "contact_id") for n, q in enumerate(QUERIES)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return sorted(map(tuple, out.collect()))

    assert found(lambda q: search_index.search_index(spark, path, q, fields)) == found(lambda q: A.search_contacts(rows, q, fields))


def test_filters_and_pruned_blocks(spark, index):
    rows, path = index
    got = search_index.search_index(spark, path, "team", "session", type_="role", domain="gmail.com", status="invalid")
    expected = A.search_contacts(rows, "team", "session", type_="role", domain="gmail.com", status="invalid")
    assert {r.contact_id for r in got.collect()} == {r.contact_id for r in expected.collect()}
    # A rare text names one block, and the scan prunes folders by it.
    assert search_index.candidate_blocks(spark, path, "needle", "session").count() == 1
    assert search_index.candidate_blocks(spark, path, "not there", "session").count() == 0
    plan = search_index.search_index(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_cut_off_additions_are_not_read_and_can_be_repeated(spark, index, tmp_path):
    rows, _ = index
    path = str(tmp_path / "cut")
    search_index.add_to_index(rows.where("contact_id < 30"), path, "a", block_rows=10)
    search_index.add_to_index(rows.where("contact_id between 30 and 60"), path, "b", block_rows=10)
    os.remove(f"{path}/lists/added=b/_SUCCESS")
    assert search_index.additions(spark, path) == ["a"]
    assert {r.contact_id for r in search_index.search_index(spark, path).collect()} == set(range(30))
    assert all(r.contact_id < 30 for r in search_index.search_index(spark, path, "com").collect())
    assert search_index.add_to_index(rows.where("contact_id between 30 and 60"), path, "b", block_rows=10)
    assert not search_index.add_to_index(rows, path, "b")
    assert search_index.search_index(spark, path).count() == 61
    with pytest.raises(ValueError):
        search_index.add_to_index(rows, path, "../x")


def test_counts_per_day(spark, tmp_path):
    path = str(tmp_path / "counts")
    rows = spark.createDataFrame(make_contacts(), SCHEMA)
    days = [date(2024, 2, 28) + timedelta(days=n) for n in range(4)]
    for n, day in enumerate(days):
        daily_counts.add_day(rows.where(F.col("contact_id") % 4 == n), path, day)
    daily_counts.add_day(rows.where("contact_id % 4 = 1"), path, days[1])  # repeated: replaces itself
    daily_counts.add_day(rows.where("false"), path, days[3] + timedelta(days=1))
    assert daily_counts.kpis(spark, path).collect() == A.contact_kpis(rows).collect()
    assert daily_counts.facets(spark, path).collect() == A.domain_facets(rows).collect()
    middle = rows.where("contact_id % 4 in (1, 2)")
    some = daily_counts.kpis(spark, path, since=days[1], until=days[2])
    assert some.collect() == A.contact_kpis(middle).collect()
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().executedPlan().toString()


def test_sketches_of_days_merge_within_their_error(spark, tmp_path):
    path = str(tmp_path / "counts")
    rows = spark.range(60_000).selectExpr("id % 40000 as d", "id").selectExpr(
        "concat('d', d, '.com') as domain", "'role' as type", "'unknown' as mx_status", "id"
    )
    for n in range(3):
        daily_counts.add_day(rows.where(F.col("id") % 3 == n), path, date(2024, 1, 1 + n))
    near, exact = (daily_counts.kpis(spark, path, approximate=a).first() for a in (True, False))
    assert exact.domains == 40_000 and near.total == exact.total == 60_000
    # Four standard errors of a sketch of 2^14 registers.
    assert abs(near.domains - exact.domains) <= 4 * 1.04 / 2**7 * exact.domains


def test_pages_by_their_last_row(spark):
    rows = spark.createDataFrame([(None if i % 7 == 0 else f"k{i % 5}", i) for i in range(60)], "k string, n int")
    last, seen = None, []
    while page := A.page_after(rows, ["k", "n"], last, size=7).collect():
        seen += page
        last = tuple(page[-1])
    assert seen == rows.orderBy("k", "n").collect()
    assert A.page_of(rows, ["k", "n"], page=2, size=7, total=60).collect() == A.page_of(rows, ["k", "n"], page=2, size=7).collect()


def test_runs_are_whole_characters_and_found_once(spark):
    texts = ["", "a", "ab", "a\U0001f600b\u00e9\n\U0001f600b", "aaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", search_index._runs(F.col("t")).alias("r")).collect()
    for row in got:
        want = {row.t[i : i + n] for n in (1, 2, 3) for i in range(len(row.t) - n + 1)}
        assert len(row.r) == len(set(row.r)) and set(row.r) == want
