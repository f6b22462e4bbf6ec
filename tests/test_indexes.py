"""Joins to tables of ranges, rules and targets against all pairs in Python."""

import io
import ipaddress
import random
from contextlib import redirect_stdout

from contactlake.operators.deliverability import enrich_asn, fingerprint_provider
from contactlake.operators.policy import url_safety
from contactlake.operators.ranges import longest_match
from contactlake.operators.rules import first_rule
from contactlake.operators.typos import nearest_target


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_longest_match_equals_all_pairs(spark):
    rng = random.Random(5)
    four = [f"{rng.randint(1, 3)}.{rng.randint(0, 3)}.{rng.randint(0, 3)}.0/{n}" for n in range(33) for _ in range(4)]
    six = [f"2001:db8:{rng.randint(0, 3):x}::{rng.randint(0, 3):x}/{n}" for n in range(0, 129, 3) for _ in range(3)]
    ranges = [str(ipaddress.ip_network(x, strict=False)) for x in four + six]
    ips = [f"{rng.randint(1, 4)}.{rng.randint(0, 3)}.{rng.randint(0, 3)}.{rng.randint(0, 2)}" for _ in range(150)]
    ips += [f"2001:db8:{rng.randint(0, 4):x}::{rng.randint(0, 3):x}" for _ in range(150)]
    nets = [ipaddress.ip_network(x) for x in ranges]

    def brute(ip):
        a = ipaddress.ip_address(ip)
        held = [n for n in nets if n.version == a.version and a in n]
        return max(held, key=lambda n: n.prefixlen).with_prefixlen if held else None

    rows = spark.createDataFrame([(x, "own") for x in [*ips, ips[0], "example.com", None]], "ip string, v0 string")
    table = spark.createDataFrame([(x,) for x in [*ranges, "nonsense", "1.2.3.4/99", None]], "cidr string")
    out = longest_match(rows, table)
    got = out.collect()
    assert len(got) == len(ips) + 3 and all(r.v0 == "own" for r in got)
    assert {r.ip: r.cidr for r in got if r.ip in ips} == {ip: brute(ip) for ip in ips}
    assert all(r.cidr is None for r in got if r.ip not in ips)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert {r.cidr for r in longest_match(rows, table.limit(0)).collect()} == {None}


def test_spellings_of_addresses(spark):
    rows = [
        ("0x7f.1", "127.0.0.0/8"), ("2130706433", "127.0.0.0/8"), ("::ffff:127.0.0.9", "127.0.0.0/8"), ("::ffff:7f00:9", "127.0.0.0/8"), ("[::1]", "::1"),
        ("0:0:0:0:0:0:0:1", "::1"), ("fe80::1%eth0", "fe80::/10"), ("64:ff9b::10.1.2.3", "64:ff9b::0a01:0/112"), ("1::2::3", None), ("1:2:3", None),
        ("::ffff:10.9.8.7", "::ffff:10.9.0.0/112"), ("12345::", None), ("::", None), ("1:2:3:4:5:6:7:8:9", None),
    ]
    table = spark.createDataFrame([(x,) for x in ("127.0.0.0/8", "::1", "fe80::/10", "64:ff9b::0a01:0/112", "::ffff:10.9.0.0/112")], "cidr string")
    got = {r.ip: r.cidr for r in longest_match(spark.createDataFrame([(a,) for a, _ in rows], "ip string"), table).collect()}
    assert got == dict(rows)


def test_url_safety_with_a_range_table(spark):
    urls = spark.createDataFrame([("https://a.com",), ("https://b.com",), ("https://[2606:1::5]/x",), ("https://8.8.8.8",)], "url string")
    resolved = spark.createDataFrame([("a.com", "2606:2::1"), ("a.com", "8.8.4.4"), ("b.com", "8.8.4.4")], "host string, ip string")
    ranges = spark.createDataFrame([("2606::/16",), ("10.0.0.0/8",)], "cidr string")
    got = {r.url: r.unsafe_reason for r in url_safety(urls, resolved, ranges=ranges).collect()}
    assert got == {
        "https://a.com": "resolves_to_restricted_ip", "https://b.com": None, "https://[2606:1::5]/x": "restricted_ip", "https://8.8.8.8": None,
    }


def test_first_rule_equals_all_pairs(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc.") for _ in range(n))
    rules = [(i, word(rng.randint(1, 7)), f"p{i}") for i in range(60)] + [(3, "abca", "tie"), (90, None, "null"), (1, "ABCABC", "upper")]
    texts = [word(rng.randint(0, 14)) for _ in range(400)] + ["abcabc" * 2, "ABCA"]

    def brute(text):
        hits = [(o, p.lower(), a) for o, p, a in rules if p is not None and p.lower() in text.lower()]
        return min(hits)[2] if hits else None

    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "host string")
    table = spark.createDataFrame(rules, "ord int, pattern string, name string")
    out = first_rule(rows, table, "host", ["name"])
    got = out.collect()
    assert len(got) == len(texts) + 1
    assert {r.host: r.name for r in got} == {**{t: brute(t) for t in texts}, None: None}
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert {r.name for r in first_rule(rows, table.limit(0), "host", ["name"]).collect()} == {None}
    every = spark.createDataFrame([(5, "", "all"), (6, "a", "late")], "ord int, pattern string, name string")
    assert {(r.host is None, r.name) for r in first_rule(rows, every, "host", ["name"]).collect()} == {(False, "all"), (True, None)}


def test_provider_and_network_tables(spark):
    df = spark.createDataFrame([("mx.Alpha.net", "old"), ("nothing", "old"), (None, "old")], "host string, provider string")
    rules = spark.createDataFrame([(2, "alpha", "Late", True), (1, "a.net", "First", False)], "ord int, pattern string, provider string, is_catch_all boolean")
    got = {(r.host, r.provider, r.is_catch_all) for r in fingerprint_provider(df, "host", rules, "None").collect()}
    assert got == {("mx.Alpha.net", "First", False), ("nothing", "None", False), (None, "None", False)}
    nets = spark.createDataFrame([(1, "alpha", "I", "AS1", "DE", "B")], "ord int, pattern string, isp string, asn string, country string, city string")
    assert {(r.host, r.isp, r.city) for r in enrich_asn(df, "host", nets).collect()} == {("mx.Alpha.net", "I", "B"), ("nothing", None, None), (None, None, None)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_nearest_target_equals_all_pairs(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab.") for _ in range(n))
    targets = [(rng.randint(0, 30), word(rng.randint(1, 8))) for _ in range(50)]
    domains = [word(rng.randint(0, 10)) for _ in range(300)] + ["b" * 5000, " A.B "]
    best = {}
    for o, t in targets:
        best[t] = min(best.get(t, o), o)

    def brute(d):
        d = d.lower().strip()
        hits = [(o, t) for t, o in best.items() if abs(len(d) - len(t)) <= 1 and distance(d, t) <= 2] if len(d) < 50 else []
        return None if d in best or not hits else min(hits)[1]

    rows = spark.createDataFrame([(x,) for x in [*domains, None]], "domain string")
    table = spark.createDataFrame([*targets, (1, None)], "ord int, target string")
    out = nearest_target(rows, table)
    got = out.collect()
    assert len(got) == len(domains) + 1
    assert {r.domain: r.typo_target for r in got} == {**{d: brute(d) for d in domains}, None: None}
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert {r.typo_target for r in nearest_target(rows, table.limit(0)).collect()} == {None}


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_no_filter_reads_addresses_again(spark):
    rows = spark.createDataFrame([("10.1.2.3",), (" [::ffff:10.1.2.3%eth0]",), ("host.com",), (None,)], "ip string")
    ranges = spark.createDataFrame([("10.0.0.0/8",), ("10.0.0.0/8",)], "cidr string")
    found = longest_match(rows, ranges)
    assert not [line for line in _plan(found).splitlines() if "Filter" in line and "conv(" in line]
    assert sorted((r.ip or "", r.cidr or "") for r in found.collect()) == [
        ("", ""), (" [::ffff:10.1.2.3%eth0]", "10.0.0.0/8"), ("10.1.2.3", "10.0.0.0/8"), ("host.com", ""),
    ]


def test_forms_of_targets_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(1, "gmail.com", "gmial.com")], "ord int, target string, domain string").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    found = nearest_target(table.select("domain"), table.select("ord", "target"))
    assert "SortMergeJoin [__form" in _plan(found, "executedPlan")
    assert found.first().typo_target == "gmail.com"
