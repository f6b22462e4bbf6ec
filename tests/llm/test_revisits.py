"""Revisits: canonical URLs, as-of choice, validators, merged headers, a hot URL."""

from pyspark.sql import functions as F

from contactlake.llm import revisits as R

SCHEMA = ("record_id string, kind string, url string, captured_at long, headers array<struct<name:string,value:string>>, "
          "payload_sha256 string, payload_chars long, outcome string")


def test_canonical_urls(spark):
    cases = {
        "HTTP://WWW.Example.com:80/a/b/?b=2&a=1&utm_source=x#top": "example.com/a/b?a=1&b=2", "https://example.com": "example.com",
        "https://u:p@example.com/?ref=1": "example.com", " example.com/x// ": "example.com/x", "": "", "http://e.com:8080/A?": "e.com:8080/A",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.c for r in df.select("u", R.canonical_url(F.col("u")).alias("c")).collect()} == cases


def resolve(spark, rows):
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    return {r.revisit_id: r for r in R.resolve_revisits(df).collect()}


def test_choice_validators_and_headers(spark):
    tag = [("ETag", '"x"'), ("Content-Length", "9"), ("Vary", "a")]
    rows = [
        ("r1", "response", "http://e.com/p", 10, tag, "s1", 9), ("r2", "response", "https://www.e.com/p/", 20, [("ETag", 'W/"y"'), ("Last-Modified", "m")], "s2", 8),
        ("v0", "revisit", "e.com/p", 10, [], None, None), ("v1", "revisit", "e.com/p", 15, [("etag", 'W/"x"'), ("Content-Length", "0"), ("vary", "b")], None, None),
        ("v2", "revisit", "e.com/p#f", 21, [("etag", '"x"')], None, None), ("v3", "revisit", "e.com/p", 22, [("Last-Modified", "m")], None, None),
        ("v4", "revisit", "e.com/p", 23, None, None, None), ("v5", "revisit", None, 5, None, None, None),
        ("v6", "revisit", "e.com/p", None, [], None, None), ("r9", "response", "e.com/p", None, [], "s9", 1),
        ("r8", "response", "e.com/p", 22, [("Last-Modified", "n")], "s8", 1), ("r7", "response", None, 1, None, "s7", 0),
    ]
    got = resolve(spark, rows)
    assert {k: (r.outcome, r.response_id) for k, r in got.items()} == {
        "v0": ("missing", None), "v1": ("resolved", "r1"), "v2": ("mismatch", None), "v3": ("resolved", "r2"),
        "v4": ("unvalidated", "r8"), "v5": ("unvalidated", "r7"), "v6": ("missing", None),
    }
    assert [(h.name, h.value) for h in got["v1"].headers] == [("Content-Length", "9"), ("etag", 'W/"x"'), ("vary", "b")]
    assert got["v1"].payload_sha256 == "s1" and got["v5"].headers == []
    assert resolve(spark, []) == {}


def test_hot_url_and_repeated_rows(spark):
    rows = [(f"r{i}", "response", "e.com", i * 10, [("ETag", f"{i}")], f"s{i}", i) for i in range(500)]
    rows += [(f"v{i}", "revisit", "http://e.com/", i * 10 + 5, [("ETag", f"{i}")], None, None) for i in range(500)]
    got = resolve(spark, rows + rows[:1])
    assert all(got[f"v{i}"].response_id == f"r{i}" for i in range(500))
    twice = spark.createDataFrame([(*r, None) for r in rows[500:502] + rows[500:501] + rows[:2]], SCHEMA)
    assert sorted(r.revisit_id for r in R.resolve_revisits(twice).collect()) == ["v0", "v0", "v1"]
