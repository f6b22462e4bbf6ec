import json
import random

import pytest
from pyspark.sql import functions as F

from contactlake.operators import crm, datasets, graph, links
from contactlake.operators.joins import lookup
from contactlake.operators.ordering import running
from contactlake.schemas import CONTACTS
from contactlake.sinks import exports
from contactlake.sources import imports, stores


def contacts(spark, rows):
    names = spark.createDataFrame([], CONTACTS).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CONTACTS)


def test_running_matches_brute_force_with_a_hot_key(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", rng.randrange(50), i, rng.randrange(-5, 6)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int")
    out = running(df, ["k"], [F.col("t"), F.col("id")], row_number="n", sums={"s": F.col("v")}, maxima={"m": F.col("v") - F.col("n")}, ranges=5)
    state, want = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        n, s, m = state.get(k, (0, 0, -10**9))
        n, s = n + 1, s + v
        state[k] = (n, s, max(m, v - n))
        want[i] = state[k]
    assert {r.id: (r.n, r.s, r.m) for r in out.collect()} == want


def test_upsert_and_session(spark):
    cols = "folder_id string, email string, pos int, v string"
    old = spark.createDataFrame([("f", "A@x.com", 1, "old"), ("f", "b@x.com", 2, "keep")], cols)
    new = spark.createDataFrame([("f", "a@x.com", 1, "mid"), ("f", "a@X.com", 2, "new"), ("f", "c@x.com", 3, "c"), ("f", "", 4, "none")], cols)
    got = [(r.pos, r.email, r.v) for r in datasets.upsert_folder(old, new).orderBy("pos").collect()]
    assert got == [(1, "a@X.com", "new"), (2, "b@x.com", "keep"), (3, "c@x.com", "c")]
    assert datasets.upsert_folder(old, new, cap=2).count() == 2
    assert datasets.upsert_folder(old, new, cap=None).count() == 3
    deep = datasets.upsert_folder(old, new, cap=5000)
    assert sorted((r.pos, r.v) for r in deep.collect()) == [(1, "new"), (2, "keep"), (3, "c")]
    first = {r.email: r.v for r in datasets.merge_session(old, new.where("email <> ''")).collect()}
    assert first == {"A@x.com": "old", "b@x.com": "keep", "c@x.com": "c"}


def test_quarantine_partitions_the_input(spark, tmp_path):
    rows = [{"email": f"{s}@x.com", "mx_status": s} for s in ("deliverable", "undeliverable", "disposable")] + [{"email": "n@x.com"}]
    df = contacts(spark, rows)
    datasets.quarantine_to(df, str(tmp_path / "kept"), str(tmp_path / "dead"), ("undeliverable", "disposable"))
    kept = {r.email for r in spark.read.parquet(str(tmp_path / "kept")).collect()}
    dead = {r.email for r in spark.read.parquet(str(tmp_path / "dead")).collect()}
    assert kept == {"deliverable@x.com", "n@x.com"} and dead == {"undeliverable@x.com", "disposable@x.com"}


def test_deep_and_shallow_pages_agree(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("g"))
    shallow = [r.id for r in datasets.page_of(df, ["g", "id"], 3, 10).collect()]
    assert sorted(r.id for r in datasets.page_of(df, ["g", "id"], 3, 10, deep=True).collect()) == sorted(shallow)
    assert datasets.page_of(df, ["id"], 99, 30).first().page == 4


def test_identity_and_payload(spark):
    rows = [
        {"email": "sarah.connor@sky.net", "domain": "sky.net", "name": "Sarah Connor", "job_id": "1"},
        {"email": "ceo@sky.net", "domain": "sky.net", "name": "Dr. Elena Rostova", "source_url": "https://acme.com/team", "job_id": "1"},
        {"email": "alex@acme.com", "domain": "acme.com", "job_id": "2"}, {"email": "ALEX@acme.com", "domain": "acme.com", "job_id": "2"},
        {"email": "alex@acme.com ", "domain": "other.com", "job_id": "2"},
    ]
    df = contacts(spark, rows).withColumn("ord", F.monotonically_increasing_id())
    by = {r.email: r.contact for r in crm.crm_contacts(df).collect()}
    assert by["sarah.connor@sky.net"].name is None
    assert by["sarah.connor@sky.net"].identityInference.firstName == "Sarah"
    assert by["ceo@sky.net"].name == "Dr. Elena Rostova" and by["ceo@sky.net"].identityInference is None
    assert by["ceo@sky.net"].sourceType == "TEAM_PAGE"
    docs = {r.job_id: json.loads(r.payload) for r in crm.crm_payloads(df).collect()}
    assert len(docs["2"]["contacts"]) == 1 and "domain" not in docs["2"]["company"]
    assert docs["1"]["company"] == {"domain": "sky.net"} and docs["1"]["version"] == "1.0"


def test_payload_parts_lose_nothing(spark):
    df = contacts(spark, [{"email": f"u{i}@x.com", "domain": "x.com", "job_id": "1"} for i in range(500)]).withColumn("ord", F.monotonically_increasing_id())
    parts = crm.crm_payloads(df, part_size=50).collect()
    seen = [c["email"] for p in parts for c in json.loads(p.payload)["contacts"]]
    assert len(parts) == 10 and len(seen) == len(set(seen)) == 500


def test_ledger_is_exactly_once(spark):
    payloads = spark.createDataFrame([("a", 3), ("b", 4), ("b", 4)], "request_id string, contact_count int")
    ledger = spark.createDataFrame([("a",)], "request_id string")
    answers = spark.createDataFrame([("b", 2, 1, 1)], "request_id string, accepted int, duplicates int, rejected int")
    assert tuple(crm.sync_ledger(payloads, ledger, answers).first()) == (1, 1, 2, 1, 1)


EXPORT = [{
    "email": "=cmd|/c calc!A0@gmail.com", "name": '+John "J" Doe', "company": "@Acme", "domain": "gmail.com", "type": "personal",
    "source_url": "https://x.com", "page_title": "T", "context_snippet": "a\r\nb",
}]


def test_exports(spark, tmp_path):
    df = contacts(spark, EXPORT)
    path = str(tmp_path / "csv")
    exports.write_csv(df.coalesce(1), path, ["email", "name", "company", "contextSnippet"])
    assert whole(tmp_path / "csv") == (
        '﻿"Email","Name","Company","Context Snippet"\r\n'
        '"\'=cmd|/c calc!A0@gmail.com","\'+John ""J"" Doe","\'@Acme","a b"\r\n'
    )
    assert exports.csv_header(["email", "domain"]) == '"Email","Domain"'
    row = json.loads(exports.json_lines(df, ["email", "type", "phone", "isCatchAll"]).first().value)
    assert row == {"email": EXPORT[0]["email"], "type": "personal", "phone": "", "isCatchAll": ""}
    exports.write_vcard(df.coalesce(1), str(tmp_path / "vcf"))
    (card,) = (tmp_path / "vcf").glob("part-*")
    text = card.read_bytes().decode()
    assert text.startswith("BEGIN:VCARD\r\nVERSION:3.0\r\nFN:+John") and "ORG:GMAIL.COM" in text
    assert "NOTE:Discovered on: T | Source: https://x.com | Snippet: a b\r\nEND:VCARD" in text


def test_export_job_writes_audit(spark, tmp_path):
    df = contacts(spark, [{"email": "a@ok.com", "domain": "ok.com"}, {"email": "j@bad.com", "domain": "bad.com"}, {"email": "b@ok.com", "domain": "ok.com"}])
    sup = spark.createDataFrame([("1", "domain", "bad.com", "BOUNCE")], "id string, type string, value string, reason string")
    audit = exports.export_contacts(df, str(tmp_path / "leads"), "txt", suppressed=sup, audit_path=str(tmp_path / "audit"), user="u1", fields=["email"])
    row = audit.first()
    assert (row.record_count, row.user_id, row.filter_suppressed, row.exported_fields) == (2, "u1", True, ["email"])
    assert {r.value for r in spark.read.text(str(tmp_path / "leads")).collect()} == {"a@ok.com", "b@ok.com"}


CSV = """Email,Full Name,Company,Title,Phone
alex.smith@cloudflare.com,"Smith, Alex",Cloudflare,VP Engineering,+14155550100
elena@google.com,Elena Rostova,Google,Director,+18005550199
temp.user@mailinator.com,Temp User,Disposable Org,Tester,
bad-email-without-at.com,Broken User,Unknown,Lead,
fakeuser@thishostnamedefinitelydoesnotexist991823.xyz,Fake User,Fake Inc,Tester,

alex.smith@cloudflare.com,Duplicate Alex,Cloudflare,VP Engineering,
"""
TXT = """
    info@github.com
    support@stripe.com
    invalid..email@bad
    Vance <marcus.vance@techcorp.io>
    marcus.vance@techcorp.io
"""


def test_import_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    (tmp_path / "b.txt").write_text(TXT)
    (tmp_path / "c.csv").write_text("person\tx\nDana\tdana@x.org\n")
    got = imports.import_contacts_csv(spark, str(tmp_path))
    rows = {(r.file[-5:], r.email): r for r in got.accepted.collect()}
    assert rows[("a.csv", "alex.smith@cloudflare.com")].name == "Smith, Alex"
    assert rows[("a.csv", "alex.smith@cloudflare.com")].company == "Cloudflare"
    assert rows[("b.txt", "info@github.com")].type == "role" and rows[("b.txt", "info@github.com")].job_title == "Department Desk"
    assert rows[("b.txt", "marcus.vance@techcorp.io")].name == "Vance"
    assert rows[("c.csv", "dana@x.org")].name == "Dana"
    totals = {r.file[-5:]: (r.total_rows, r.valid, r.invalid, r.duplicates) for r in got.summary.collect()}
    assert totals == {"a.csv": (6, 4, 1, 1), "b.txt": (5, 3, 1, 1), "c.csv": (1, 1, 0, 0)}
    bad = {(r.file[-5:], r.line): r.reason for r in got.rejected.collect()}
    assert bad == {("a.csv", 5): 'Missing "@" symbol or empty email', ("b.txt", 3): "Invalid email syntax format"}


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("\n".join(f"u{i}@x.com" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = imports.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        assert lines.where(F.concat(F.lit("u"), F.col("line") - 1, F.lit("@x.com")) != F.col("value")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_import_json(spark, tmp_path):
    items = [{"email": "sarah.connor@sky.net", "name": "Sarah Connor", "company": "Resistance"}, {"mail": "john.doe@gmail.com"}, "x@y.com", {"name": "none"}]
    (tmp_path / "a.json").write_text(json.dumps(items))
    (tmp_path / "b.json").write_text(json.dumps({"emails": 1, "contacts": [{"address": "k@l.org", "tags": ["vip"]}]}))
    (tmp_path / "c.json").write_text("plain@text.org\n")
    got = imports.import_contacts_json(spark, str(tmp_path))
    rows = {r.email: r for r in got.accepted.collect()}
    assert set(rows) == {"sarah.connor@sky.net", "john.doe@gmail.com", "x@y.com", "k@l.org", "plain@text.org"}
    assert rows["john.doe@gmail.com"].email_category == "Personal" and rows["k@l.org"].tags == ["vip"]
    assert [r.reason for r in got.rejected.collect()] == ["No email field found"]


def test_quoted_cells(spark):
    line = 'a"b""c",,"x ""y"" z","",last'
    df = spark.createDataFrame([(line,)], "l string").select(imports.cells(F.col("l"), F.lit(",")).alias("c"))
    assert df.first().c == ['ab"c', "", 'x "y" z', "", "last"]


def test_stores(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"id": "1", "type": "email", "value": "a@b.c", "reason": "BOUNCE", "createdAt": "2024-01-02T03:04:05.000Z"}]))
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs" / "1.json").write_text(json.dumps({"id": "j1", "ownerId": "u", "status": "running", "startedAt": 1700000000000, "retryCount": 0, "maxRetries": 1}))
    (tmp_path / "jobs" / "2.json").write_text("{broken")
    assert stores.read_suppression(spark, str(tmp_path / "s.json")).first().created_at.year == 2024
    jobs = stores.read_jobs(spark, str(tmp_path / "jobs"))
    assert [(r.job_id, r.owner) for r in jobs.collect()] == [("j1", "u")]
    again = datasets.recover_stale(jobs, F.current_timestamp()).first()
    assert (again.status, again.retry_count) == ("queued", 1)


SITE = {
    "https://s.com/": '<a href="/about">About</a> <a href="team?utm_source=x#t">Team</a> <a href="https://other.com/">x</a>',
    "https://s.com/about": '<a href="/">home</a> a@s.com', "https://s.com/team": '<a href="./careers/../careers">jobs</a> b@s.com a@s.com',
    "https://s.com/careers": "c@s.com",
}


def test_site_crawl(spark):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(SITE.items())], "page_id int, url string, html string")
    edges = links.extract_links(pages)
    seeds = spark.createDataFrame([("https://s.com/",)], "url string")
    front = graph.crawl_frontier(seeds, edges, max_depth=3)
    assert {r.url: r.depth for r in front.collect()} == {"https://s.com/": 0, "https://s.com/about": 1, "https://s.com/team": 1, "https://s.com/careers": 2}
    from contactlake.operators.extraction import extract_contact_records

    got = {r.email: r.source_url for r in graph.site_contacts(front, extract_contact_records(pages)).collect()}
    assert got == {"a@s.com": "https://s.com/about", "b@s.com": "https://s.com/team", "c@s.com": "https://s.com/careers"}
    assert {r.depth for r in graph.crawl_frontier(seeds, edges, max_depth=1).collect()} == {0, 1}
    assert graph.crawl_frontier(seeds, edges, max_pages=2).count() == 2
    assert graph.crawl_frontier(seeds, edges, max_pages=None).count() == 4
    assert graph.checked_limits() == (2, 30) and graph.checked_limits(10, 200) == (10, 200)
    for bad in ((99, 1), (1, 999), (0, 1)):
        with pytest.raises(ValueError):
            graph.checked_limits(*bad)


def test_import_summary_parses_rows_once(spark):
    values = ["E-Mail,Name", "a@acme.com,A", "A@acme.com,B", "none,C", "b@acme.com,D", *[f"bad{i},x" for i in range(12)]]
    rows = [("f", i + 1, v) for i, v in enumerate(values)] + [("f", 4, "none,C"), ("g", 1, "c@acme.com")]
    lines = spark.createDataFrame(rows, "file string, line long, value string")
    parsed = imports.parse_lines(lines)
    result = imports.finish_import(parsed)
    got = {r.file: r for r in result.summary.collect()}
    assert tuple(got["f"])[1:5] == (17, 2, 14, 1) and tuple(got["g"])[1:5] == (1, 1, 0, 0)
    assert [(e.line, e.raw) for e in got["f"].errors] == [(4, "none,C"), (4, "none,C"), *[(i + 6, f"bad{i},x") for i in range(8)]]
    assert got["g"].errors is None and result.accepted.count() == 3
    # Counts and errors are taken from rows that are parsed already; lines are never the broadcast side.
    assert "RLIKE" not in result.summary._jdf.queryExecution().sparkPlan().toString()
    join = parsed._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in join and "SortMergeJoin" not in join


def depths(seeds, edges):
    """Least number of links that cost 1, by relaxing every edge until nothing changes."""
    found = {s: 0 for s in seeds}
    while True:
        better = {b: found[a] + cost for a, b, cost in edges if a in found and found[a] + cost < found.get(b, 1 << 30)}
        if not better:
            return found
        found |= {b: min(found[a] + cost for a, x, cost in edges if x == b and a in found) for b in better}


def test_crawl_with_canonical_edges_and_refusals(spark):
    rng = random.Random(3)
    page = "https://s.com/p{}".format
    pairs = [(page(rng.randrange(60)), page(rng.randrange(60))) for _ in range(110)] + [(page(1), None), (None, page(2)), (page(1), "https://o.com/x")]
    same = [(page(rng.randrange(60)), page(rng.randrange(60))) for _ in range(25)]
    refused = {page(i) for i in range(3, 60, 7)}
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    seeds = frame([(page(0),), (page(1),), (page(1),), (page(3),)], "url string")
    verdicts = frame([(u, False) for u in refused] + [(page(5), True), (page(6), None)], "url string, allowed boolean")
    edges = [(a, b, 1) for a, b in pairs if a and b] + [(a, b, 0) for a, b in same]
    want = depths([page(0), page(1)], [e for e in edges if e[1] not in refused])
    args = (seeds, frame(pairs, "src string, dst string"))
    for max_depth, same_domain in ((None, True), (2, True), (None, False)):
        got = graph.crawl_frontier(*args, max_depth, same_domain=same_domain, allowed=verdicts, canonical=frame(same, "src string, dst string"))
        expected = {u: d for u, d in want.items() if (max_depth is None or d <= max_depth) and not (same_domain and "o.com" in u)}
        assert sorted((r.url, r.depth) for r in got.collect()) == sorted(expected.items())


def test_a_crawl_takes_one_small_step_per_level(spark):
    page = "https://s.com/p{}".format
    chain = spark.createDataFrame([(page(i), page(i + 1)) for i in range(10)], "src string, dst string")
    canonical = spark.createDataFrame([(page(10), page(11))], "src string, dst string")
    group, sc = "one-crawl", spark.sparkContext
    sc.setJobGroup(group, group)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        front = graph.crawl_frontier(chain.limit(1).selectExpr("src as url"), chain, max_pages=100, canonical=canonical)
        tasks = sum(
            sc.statusTracker().getStageInfo(stage).numTasks
            for job in sc.statusTracker().getJobIdsForGroup(group) for stage in sc.statusTracker().getJobInfo(job).stageIds
            if sc.statusTracker().getStageInfo(stage)
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r.url: r.depth for r in front.collect()} == {page(i): min(i, 10) for i in range(12)}
    # Steps that fix their number of tasks start several times 64 of them per level.
    assert tasks < 1200, tasks


def whole(path):
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*"))).decode()


def test_one_header_per_export_and_json_array(spark, tmp_path):
    df = contacts(spark, [{"email": f"a{i}@b.com", "name": "N"} for i in range(9)]).repartition(3)
    exports.write_csv(df, str(tmp_path / "c"), ["email"])
    text = whole(tmp_path / "c")
    assert text.startswith(exports.BOM) and text.count(exports.csv_header(["email"])) == 1 and text.count("\r\n") == 10
    exports.write_csv(df.limit(0), str(tmp_path / "e"), ["email"])
    assert whole(tmp_path / "e") == exports.BOM + exports.csv_header(["email"]) + "\r\n"
    exports.write_json(df, str(tmp_path / "j"), ["email"], array=True)
    assert sorted(x["email"] for x in json.loads(whole(tmp_path / "j"))) == [f"a{i}@b.com" for i in range(9)]
    exports.write_json(df.limit(0), str(tmp_path / "z"), ["email"], array=True)
    assert json.loads(whole(tmp_path / "z")) == []


def test_json_lines_import(spark, tmp_path):
    lines = ['{"email": "a@b.com", "name": "Ann"}', '{"email": "c@d.com"}', '{"x": 1}', "no json at all"]
    (tmp_path / "list.json").write_text("\n".join(lines))
    for read in (imports.import_contacts_json, imports.import_contacts_jsonl):
        result = read(spark, str(tmp_path))
        assert {r.email: r.name for r in result.accepted.collect()}.keys() == {"a@b.com", "c@d.com"}
        assert sorted((r.line, r.reason) for r in result.rejected.collect()) == [(3, "No email field found"), (4, "No email field found")]
        assert {r.raw for r in result.rejected.collect()} == {'{"x": 1}', "no json at all"}


def test_a_hot_key_is_split(spark):
    """An address with a third of the rows: adaptive execution splits its partition of the join."""
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        facts = spark.range(0, 200_000, 1, 8).selectExpr(
            "case when id % 3 = 0 then 'hot' else concat('k', id % 5000) end as key", "id", "sha2(cast(id as string), 256) as pad"
        )
        dim = spark.range(5000).selectExpr("concat('k', id) as key", "id as v").union(spark.sql("select 'hot', -1L"))
        out = lookup(facts, dim, "key").groupBy("key").agg(F.count("*").alias("n"))
        assert {r.key: r.n for r in out.where("key = 'hot'").collect()} == {"hot": 66_667}
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
