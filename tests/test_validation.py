from pyspark.sql import functions as F

from contactlake.functions import addresses as A
from contactlake.operators import deliverability as M
from contactlake.operators import validation as V
from contactlake.plans.contacts import validate_contacts


def emails(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "email string")


def test_canonical(spark):
    pairs = {
        "john.doe+newsletter@gmail.com": "johndoe@gmail.com", "J.O.H.N+sales@googlemail.com": "john@gmail.com",
        "support+urgent@company.org": "support@company.org", "+x@a.com": "+x@a.com", "no-at": "no-at",
    }
    df = emails(spark, *pairs).select("email", A.canonical(F.col("email")).alias("c"))
    assert {r.email: r.c for r in df.collect()} == pairs
    twice = df.select(F.col("c"), A.canonical(F.col("c")).alias("cc")).where("c <> cc")
    assert twice.count() == 0


def test_typos(spark):
    pairs = {
        "gmaill.com": "gmail.com", "gmial.com": "gmail.com", "hotmial.com": "hotmail.com", "outlok.com": "outlook.com",
        "yaho.com": "yahoo.com", "iclud.com": "icloud.com", "protonmai.com": "protonmail.com", "enterprise.co.uk": None,
        "gmail.com": None,
    }
    df = emails(spark, *pairs).select("email", A.typo_target(F.col("email")).alias("t"), A.typo_target(F.col("email"), compat=True).alias("c"))
    rows = {r.email: r for r in df.collect()}
    assert {k: r.t for k, r in rows.items()} == pairs
    assert rows["gmail.com"].c == "mail.com"


def test_entropy(spark):
    df = emails(spark, "alexsmith", "qzxkjfw98721plm", "").select("email", A.entropy(F.col("email")).alias("e"))
    df = df.withColumn("g", A.is_gibberish(F.col("email"), F.col("e")))
    got = {r.email: (r.e, r.g) for r in df.collect()}
    assert got == {"alexsmith": (0.7, False), "qzxkjfw98721plm": (0.87, True), "": (0.0, False)}


def test_static_checks(spark):
    df = V.validate_static(emails(
        spark, "user@testdomain.test", "admin@example.com", "user@-badlabel-.com", "user..name@gmail.com",
        "test@mailinator.com", "support@stripe.com", "john@gmail.com", "spamtrap@domain.com", "a@b.arpa",
    ))
    rows = {r.email: r for r in df.collect()}
    assert not rows["user@testdomain.test"].passed
    assert any("RFC 2606" in f for f in rows["user@testdomain.test"].failed_checks)
    assert not rows["admin@example.com"].passed
    assert any("RFC 1035" in f for f in rows["user@-badlabel-.com"].failed_checks)
    assert any("RFC 5321" in f for f in rows["user..name@gmail.com"].failed_checks)
    assert rows["test@mailinator.com"].is_disposable and any("Disposable" in f for f in rows["test@mailinator.com"].failed_checks)
    assert rows["support@stripe.com"].is_role_account and rows["support@stripe.com"].passed
    assert rows["john@gmail.com"].is_free_mail and rows["john@gmail.com"].score == 100
    assert rows["spamtrap@domain.com"].is_spam_trap and rows["spamtrap@domain.com"].passed


def test_static_validation_is_map_only(spark):
    plan = V.validate_static(emails(spark, "a@b.com"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_disposable_table(spark):
    listed = spark.createDataFrame([("Burner.example",), ("burner.example",)], "domain string")
    got = {r.email: r.is_disposable for r in V.validate_static(emails(spark, "a@burner.example", "a@mailinator.com"), disposable=listed).collect()}
    assert got == {"a@burner.example": True, "a@mailinator.com": False}


DNS = [
    ("google.com", 15, "10 smtp.google.com."), ("google.com", 15, "5 aspmx.l.google.com."), ("aspmx.l.google.com", 1, "142.250.1.1"),
    ("gate.com", 15, "10 mx1.pphosted.com."), ("null.com", 15, "0 ."), ("aonly.com", 1, "93.184.216.34"),
    ("gmial.com", 15, "0 mx.gmial.com."), ("bad.com", 15, "x mail.zoho.com."),
]


def dns(spark):
    return spark.createDataFrame(DNS, "domain string, rr_type int, data string")


def test_two_layers(spark):
    src = emails(
        spark, "alex.smith+test@google.com", "bad.syntax..dots@test.invalid", "disposable@mailinator.com", "typo.user@gmial.com",
        "x@gate.com", "x@null.com", "x@aonly.com", "x@absent.com", "x@bad.com",
    )
    rows = {r.email: r for r in validate_contacts(src, dns(spark)).collect()}
    status = {e: r.mailbox_status for e, r in rows.items()}
    assert status == {
        "alex.smith+test@google.com": "deliverable", "bad.syntax..dots@test.invalid": "undeliverable",
        "disposable@mailinator.com": "disposable", "typo.user@gmial.com": "deliverable", "x@gate.com": "risky",
        "x@null.com": "undeliverable", "x@aonly.com": "deliverable", "x@absent.com": "undeliverable", "x@bad.com": "deliverable",
    }
    google = rows["alex.smith+test@google.com"]
    assert google.canonical_email == "alex.smith@google.com"
    assert (google.mx_enrichment.hostname, google.mx_enrichment.priority, google.mx_enrichment.asn) == ("aspmx.l.google.com", 5, "AS15169")
    assert google.mx_enrichment.ip == "142.250.1.1"
    assert rows["typo.user@gmial.com"].typo_suggestion == "typo.user@gmail.com"
    assert rows["typo.user@gmial.com"].mx_enrichment.priority == 10
    assert rows["x@null.com"].provider.startswith("RFC 7505")
    assert rows["bad.syntax..dots@test.invalid"].checks_passed < 16
    assert not rows["disposable@mailinator.com"].valid and rows["x@aonly.com"].valid
    summary = V.validation_summary(validate_contacts(src, dns(spark))).first()
    assert (summary.total, summary.deliverable, summary.disposable, summary.risky) == (9, 4, 1, 1)


def test_null_mx_compat(spark):
    facts = {r.domain: r for r in M.resolve_mx(spark.createDataFrame([("null.com",)], "domain string"), dns(spark), compat=True).collect()}
    assert not facts["null.com"].is_null_mx and not facts["null.com"].has_mx


def test_canonical_dedupe(spark):
    rows = [(1, "j.d@gmail.com"), (2, "jd+x@gmail.com"), (3, "jd+x@gmail.com"), (4, "z@a.com")]
    df = spark.createDataFrame(rows, "id int, email string")
    got = {r.canonical_email: (r.kept_email, r.n_rows, r.n_aliases) for r in V.dedupe_canonical(df, "id").collect()}
    assert got == {"jd@gmail.com": ("j.d@gmail.com", 3, 2), "z@a.com": ("z@a.com", 1, 1)}
