"""Literal pages: decoding, tiers, phones, titles, provenance."""

import time

from pyspark.sql import functions as F

from contactlake.functions import text as T
from contactlake.operators import extraction as X

CONTACT_PAGE = """
<!doctype html><html><head><title>Harbour Works</title></head><body>
<ul>
<li>Write to the head of the yard: <a href="mailto:mira.lund@harbourworks.com">Mira Lund</a></li>
<li>Orders go to orders@harbourworks.com</li>
<li>Repairs: help@harbourworks.com</li>
<li>Anything else &#105;&#110;&#102;&#111;&#64;harbourworks.com</li>
<li>Journalists: newsroom.desk [at] harbourworks [dot] org</li>
<li>Hull plans by otto.berg@shipdesign.io</li>
<li>Our logo is logo@3x.png, the script bundle@4.1.0.js</li>
</ul></body></html>"""
TEAM_PAGE = """
<section><h2>Who we are</h2>
<p>Ring <a href="tel:+18665550142">+1 (866) 555-0142</a>, or the pier at (206) 890-4321.</p>
<a href="https://www.linkedin.com/in/nils-aker-ceo">on LinkedIn</a>
<p>Nils Aker has been Chief Executive Officer of the ferry line since spring.</p>
<p>Letters to nils.aker@ferryline.com</p></section>"""
PROVENANCE_PAGE = """
<main><a href="mailto:gate@ferryline.com">Gate</a>
<p>For lost bags try info@ferryline.com at any hour.</p>
<script>window.owner = "admin@ferryline.com";</script></main>"""


def records(spark, html):
    pages = spark.createDataFrame([(1, "https://x.com/contact", html)], "page_id long, url string, html string")
    return {r.email: r for r in X.extract_contact_records(pages, discovered_at=F.lit("t")).collect()}


def test_contact_page(spark):
    found = records(spark, CONTACT_PAGE)
    assert set(found) == {
        "mira.lund@harbourworks.com", "orders@harbourworks.com", "help@harbourworks.com", "info@harbourworks.com",
        "newsroom.desk@harbourworks.org", "otto.berg@shipdesign.io",
    }
    assert found["help@harbourworks.com"].type == "role"
    assert found["otto.berg@shipdesign.io"].type == "personal"
    assert found["orders@harbourworks.com"].page_title == "Harbour Works"


def test_team_page(spark):
    (rec,) = records(spark, TEAM_PAGE).values()
    assert (rec.name, rec.job_title) == ("Nils Aker", "Chief Executive Officer")
    assert rec.phone == "+18665550142"
    assert rec.socials.linkedin.endswith("nils-aker-ceo")


def test_provenance(spark):
    found = records(spark, PROVENANCE_PAGE)
    kinds = {e: r.context_type for e, r in found.items()}
    assert kinds == {"gate@ferryline.com": "mailto", "info@ferryline.com": "text", "admin@ferryline.com": "metadata"}
    assert found["gate@ferryline.com"].context_snippet == X.MAILTO_CONTEXT
    assert "try info@ferryline.com at" in found["info@ferryline.com"].context_snippet
    assert found["gate@ferryline.com"].extraction_method == "http"


def test_mailto_printed_in_text_becomes_text(spark):
    found = records(spark, '<a href="mailto:a.b@acme.com">write to a.b@acme.com today</a>')
    assert found["a.b@acme.com"].context_type == "text"
    assert found["a.b@acme.com"].context_snippet == "write to a.b@acme.com today"


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(fn(F.col("t")).alias("x")).first().x


def test_decoding(spark):
    cases = {
        "a%40b%2Ecom": "a@b.com",
        "100% a%40b%2ecom": "100% a@b.com",
        "x+y@c.com": "x+y@c.com",
        "&#x41;&#66;&commat;c&period;de": "AB@c.de",
        "joe (at) foo {dot} com": "joe@foo.com",
        "joe at foo dot com": "joe@foo.com",
        "caf%C3%A9": "café",
        "bad %C3 utf": "bad %C3 utf",
        "&amp;lt;": "<",
        "&#65600;": "@",
    }
    for raw, want in cases.items():
        assert one(spark, raw, T.deobfuscate) == want, raw


def test_probe_never_drops_a_text_with_an_address(spark):
    texts = [
        "a@b.com", "a%40b.com", "%61 x", "&#97;&#64;b.com", "&commat;", "a [at] b.com", "a <at> b.com", "a&lt;at&gt;b.com",
        "a at b dot com now", "A AT b DOT com ", "&amp;#64;", "plain text", "meet at noon",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.may_contain_address(F.col("t")).alias("p"), T.find_addresses(T.deobfuscate(T.deobfuscate(F.col("t")))).alias("f")).collect():
        assert r.p or not r.f, r.t
    assert not one(spark, "plain text", T.may_contain_address)


def test_addresses_in_a_row(spark):
    assert one(spark, "a@b.com1x@c.org,d@e.co.uk", T.find_addresses) == ["a@b.com", "1x@c.org", "d@e.co.uk"]
    assert one(spark, "x" * 20000 + " y@z.com", T.find_addresses) == ["y@z.com"]


def test_snippet_edges(spark):
    df = spark.createDataFrame([("Hello A@B.com bye", "a@b.com"), ("nothing", "a@b.com")], "t string, e string")
    got = [r.x for r in df.select(T.snippet(F.col("t"), F.col("e"), 3).alias("x")).collect()]
    assert got == ["...lo A@B.com by...", ""]


def test_phones(spark):
    got = one(spark, TEAM_PAGE, T.phones)
    assert got == ["+18665550142", "+1 (866) 555-0142", "(206) 890-4321"]
    assert one(spark, "202-555-0100 2025550100", T.phones) == []


def test_job_titles(spark):
    assert one(spark, "our ceo says", T.job_title) == "CEO"
    assert one(spark, "Supervisor of directories", T.job_title) is None
    assert one(spark, "see https://x.com/ceo now", T.job_title) is None
    assert one(spark, "Director of Ops and Vice President of Sales", T.job_title) == "Vice President of Sales"


def test_first_record_wins(spark):
    rows = [("a@x.com", 3, "late"), ("a@x.com", 1, "early"), ("b@x.com", 2, "only")]
    df = spark.createDataFrame(rows, "email string, visit int, page string")
    got = {r.email: r.page for r in X.unique_contacts(df, ["visit"]).collect()}
    assert got == {"a@x.com": "early", "b@x.com": "only"}


def test_extraction_stays_in_the_jvm_without_shuffle(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = X.extract_contact_records(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert plan.count("try_url_decode") <= 6
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan


def test_long_runs_stay_linear(spark):
    """Blank runs, dotted runs and many quotes of a megabyte neither hang nor overflow."""
    import time

    from contactlake.functions import addresses as A
    from contactlake.sources import imports

    n = 300_000
    start = time.time()
    blanks = "x" + " " * n + "(at) (at)" + " " * n + "y a at b dot com-x at y dot org"
    assert one(spark, blanks, T.deobfuscate) == "x@@y a@b.com-x@y.org"
    assert one(spark, "x" + " " * n + "y", T.strip_ws) == "x" + " " * n + "y"
    assert one(spark, "a." * n + "b at c dot com", lambda c: F.length(T.deobfuscate(c))) == 2 * n + len("b@c.com")
    assert one(spark, "a." * n + "b", A.is_dot_atom)
    assert one(spark, "a@" + "b." * n + "com", A.has_import_syntax)
    assert one(spark, '"",' * n, lambda c: F.size(imports.cells(c, F.lit(",")))) == n + 1
    assert time.time() - start < 60


def test_boundaries_of_spelled_addresses(spark):
    cases = {".joe at foo dot com": ".joe@foo.com", "é joe at foo dot comé": "é joe@foo.comé", "joe at foo dot com1": "joe at foo dot com1"}
    for raw, want in cases.items():
        assert one(spark, raw, T.deobfuscate) == want, raw


def test_delegated_names_decide(spark):
    names = "ninja marketing education training rocks plus photo tips guide house software".split()
    text = " ".join(f"a@b.{n}" for n in [*names, "zq", "notatld"])
    df = spark.createDataFrame([(1, text)], "id long, t string")
    assert {r.email.split(".")[1] for r in X.extract_emails(df, "id", "t").collect()} == set(names)
    own = X.extract_emails(df, "id", "t", tlds=["zq", "tips"]).collect()
    assert {r.email for r in own} == {"a@b.zq", "a@b.tips"}
    assert X.extract_emails(df, "id", "t", tlds=[]).where("email is not null").count() == 0


def test_dense_page_is_linear(spark):
    html = "<title>Staff</title>" + "".join(f"<p>Person {i} writes from person{i}@bigcorp.com daily</p>" for i in range(5000))
    start = time.time()
    found = records(spark, html)
    assert len(found) == 5000 and time.time() - start < 60
    assert found["person4999@bigcorp.com"].context_snippet.startswith("...") and found["person0@bigcorp.com"].page_title == "Staff"
