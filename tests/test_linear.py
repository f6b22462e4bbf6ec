"""Patterns stay linear on hostile pages, and mean what they did before on ordinary ones."""

import time

import pytest
from pyspark.sql import functions as F

from contactlake.functions import redact as R
from contactlake.functions import text as T
from contactlake.operators import links as L

HOSTILE = [
    "<title", "<title>", "<", "<<>", "<script", "<script></script", "<style ", "<a href='", "<a href=x", "<a ", "<link rel='canonical' ", "<link ", "-eyJ", "-eyJabcdefghijkl",
    "-eyJabcdefghijkl.eyJ", "eyJabcdefghijklm.eyJabcdefghijklm.", "password", "x@", "at ",
]


@pytest.mark.parametrize("unit", HOSTILE)
def test_time_follows_length(spark, unit):
    def took(size):
        df = spark.createDataFrame([(unit * (size // len(unit)), "https://a.com")], "html string, url string").coalesce(1)
        start = time.process_time(), time.time()
        df.select(T.page_title(F.col("html")), T.strip_markup(F.col("html")), R.redact_pii(F.col("html"))).write.format("noop").mode("overwrite").save()
        L.canonical_edges(df).write.format("noop").mode("overwrite").save()
        L.raw_hrefs(df).write.format("noop").mode("overwrite").save()
        return time.time() - start[1]

    took(1_000)
    assert took(300_000) < 12


def test_meaning(spark):
    pages = [
        ("<title a='b'> One\n two </title>", "One two", "One two"), ("a<script>x<b></script>b<SCRIPT>y", "", "a b y"), ("a<style>q</style><p>b<c", "", "a b<c"),
        ("x < y > z <> w", "", "x z <> w"), ("<script>a</script><script>b</script>c<script", "", "c<script"), ("", "", ""),
    ]
    df = spark.createDataFrame([(p[0],) for p in pages], "html string")
    got = df.select("html", T.page_title(F.col("html")).alias("t"), T.strip_markup(F.col("html")).alias("s")).collect()
    assert {r.html: (r.t, r.s) for r in got} == {h: (t, s) for h, t, s in pages}


def test_tokens(spark):
    good = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12
    cases = {good: R.TOKEN, f"x {good}.": f"x {R.TOKEN}.", f"-{good}": f"-{R.TOKEN}", f"x-{good} y": f"x-{R.TOKEN} y", f"x{good}": f"x{good}", f"eyJ-{good}": R.TOKEN, "eyJa.eyJb.c": "eyJa.eyJb.c"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.o for r in df.select("t", R.redact_pii(F.col("t")).alias("o")).collect()} == cases


def test_links(spark):
    html = """<a href="/1">x</a> <A class='q' href='/2'> <abbr href="/no"> <a data-href="/no" href="/3"> <a href=bare> <a
    href="/4"> <link href="/c" rel="canonical"> <link rel="canonical" href="/d">"""
    df = spark.createDataFrame([(html, "https://a.com/")], "html string, url string")
    assert sorted(r.href for r in L.raw_hrefs(df).collect()) == ["/1", "/2", "/3", "/4"]
    assert [(r.src, r.dst) for r in L.canonical_edges(df).collect()] == [("https://a.com/", "https://a.com/c")]


def test_blanks_of_any_kind(spark):
    wide = "         　﻿"
    every = " \t\n\x0b\f\r" + wide
    texts = [f"{b}a{b}{b}é{b}" for b in every] + [every + "x" + every + "y" + every, every, "", "a b", "​kept​", "é\x85é", None]

    def collapsed(t):
        out = "".join(" " if ch in every else ch for ch in t)
        while "  " in out:
            out = out.replace("  ", " ")
        return out

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.collapse_ws(F.col("t")).alias("c"), T.strip_ws(F.col("t")).alias("s")).collect()
    assert [(r.c, r.s) for r in got] == [(None, None) if t is None else (collapsed(t), t.strip(every)) for t in texts]
