"""Versioned CRM payloads: evidence scores, identity split, batches, delivery ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions import addresses as A
from contactlake.functions.text import WS, strip_ws
from contactlake.operators.firsts import first_per_key
from contactlake.operators.joins import lookup

VERSION = "1.0"
PART_SIZE = 1000


def source_type(url: Column) -> Column:
    low = F.lower(url)

    def has(*words: str) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        return hit

    return (
        F.when(F.coalesce(F.length(url), F.lit(0)) == 0, "RAW_TEXT")
        .when(has("/contact", "contact-us"), "CONTACT_PAGE")
        .when(has("/team", "/people", "/leadership", "/staff"), "TEAM_PAGE")
        .when(has("/about", "about-us", "/company"), "ABOUT_PAGE")
        .when(has("footer"), "FOOTER")
        .when(url.startswith("http://") | url.startswith("https://"), "WEBSITE")
        .otherwise("OTHER")
    )


def classify_source(df: DataFrame, url: str = "source_url") -> DataFrame:
    return df.withColumn("source_type", source_type(F.col(url)))


def _filled(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def score_confidence(df: DataFrame) -> DataFrame:
    """evidence_confidence in 0.10 .. 0.99, summed in whole hundredths."""
    status = F.col("mx_status")
    social = _filled(F.col("socials.linkedin")) | _filled(F.col("socials.twitter"))
    points = (
        F.lit(70)
        + F.when(status == "deliverable", 20).when(status == "disposable", -40).when(status == "undeliverable", -50).otherwise(0)
        + F.when(_filled(F.col("job_title")), 5).otherwise(0)
        + F.when(_filled(F.col("phone")), 3).otherwise(0)
        + F.when(social, 5).otherwise(0)
    )
    return df.withColumn("evidence_confidence", F.least(F.lit(99), F.greatest(F.lit(10), points)) / 100)


def map_status_type(df: DataFrame) -> DataFrame:
    status = F.col("mx_status")
    return df.withColumn(
        "email_status",
        F.when(status == "deliverable", "VALIDATED").when(status.isin("undeliverable", "disposable"), "UNVERIFIED").otherwise("FOUND"),
    ).withColumn(
        "email_type", F.when(F.col("type") == "personal", "PERSONAL").when(F.col("type") == "role", "ROLE_BASED").otherwise("UNKNOWN")
    )


def split_identity(df: DataFrame) -> DataFrame:
    """A name that only repeats the local part is an inference, not a verified name."""
    name = F.col("name")
    flat = F.regexp_replace(F.lower(name), WS + "+", "")
    local = F.regexp_replace(F.lower(A.part(F.col("email"), 0)), r"[._\-+]", "")
    words = F.split(strip_ws(name), WS + "+")
    given = _filled(name)
    inferred = given & (flat == local)
    return (
        df.withColumn(
            "identity_inference",
            F.when(
                inferred,
                F.struct(
                    F.get(words, F.lit(0)).alias("first_name"),
                    F.when(F.size(words) > 1, F.array_join(F.slice(words, 2, F.size(words)), " ")).alias("last_name"),
                    F.lit(0.45).alias("confidence"),
                    F.lit("email_local_part").alias("source"),
                ),
            ),
        )
        .withColumn("identity_source", F.when(inferred, "inferred").when(given, "website"))
        .withColumn("verified_name", F.when(given & ~inferred, name))
    )


def crm_contacts(df: DataFrame) -> DataFrame:
    """Add ``contact``: the payload struct of each record."""
    staged = split_identity(map_status_type(score_confidence(classify_source(df))))
    c = F.col
    return staged.withColumn(
        "contact",
        F.struct(
            A.normalise(c("email")).alias("email"),
            c("email_type").alias("emailType"),
            c("email_status").alias("emailStatus"),
            c("evidence_confidence").alias("confidence"),
            c("source_url").alias("sourceUrl"),
            c("source_type").alias("sourceType"),
            c("verified_name").alias("name"),
            c("job_title").alias("jobTitle"),
            F.when(
                c("identity_inference").isNotNull(),
                F.struct(
                    c("identity_inference.first_name").alias("firstName"),
                    c("identity_inference.last_name").alias("lastName"),
                    c("identity_inference.confidence").alias("confidence"),
                    c("identity_inference.source").alias("source"),
                ),
            ).alias("identityInference"),
            c("identity_source").alias("identitySource"),
            c("phone").alias("phone"),
            c("socials").alias("socials"),
            c("context_snippet").alias("contextSnippet"),
            c("depth").alias("depth"),
            c("discovered_at").alias("discoveredAt"),
            c("mx_records").alias("mxRecords"),
        ),
    )


def crm_payloads(
    df: DataFrame,
    by: str = "job_id",
    order: str = "ord",
    integration: str = "contactlake",
    source_kind: str = "website_email_scraper",
    domain: str | None = None,
    company_name: str | None = None,
    website: str | None = None,
    part_size: int = PART_SIZE,
) -> DataFrame:
    """One JSON payload per (batch, part): contacts once per address, first record wins.

    A batch of any size is spread over parts of about ``part_size`` contacts by
    the hash of the address, so no row holds an unbounded list.  The company
    domain is stated only when given or when every record of the batch has it.
    """
    keyed = df.withColumn("__email", A.normalise(F.col("email")))
    facts = keyed.groupBy(by).agg(
        F.min("domain").alias("__lo"), F.max("domain").alias("__hi"),
        F.count_if(F.col("domain").isNull()).alias("__missing"),
    )
    unique = first_per_key(keyed.where(F.length("__email") > 0), [by, "__email"], [order])
    sizes = unique.groupBy(by).agg(F.count("*").alias("__n"))
    batch = sizes.join(facts, by).select(
        by, F.ceil(F.col("__n") / part_size).cast("int").alias("parts"),
        (F.lit(domain) if domain else F.when((F.col("__lo") == F.col("__hi")) & (F.col("__missing") == 0), F.col("__lo")))
        .cast("string").alias("company_domain"),
    )
    spread = lookup(crm_contacts(unique), batch, by).withColumn(
        "part", F.pmod(F.xxhash64("__email"), F.col("parts")).cast("int")
    )
    # Each list holds about part_size contacts.
    lists = spread.groupBy(by, "part", "parts", "company_domain").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__email").alias("e"), "contact"))), lambda x: x["contact"]).alias("contacts")
    )
    request = F.sha2(F.concat_ws("|", F.col(by).cast("string"), F.col("part").cast("string"), F.array_join(F.transform("contacts", lambda x: x["email"]), ",")), 256)
    body = F.struct(
        F.lit(integration).alias("integration"), F.lit(VERSION).alias("version"), F.col("request_id").alias("requestId"),
        F.struct(F.lit(source_kind).alias("type"), F.col(by).cast("string").alias("jobId")).alias("source"),
        F.struct(
            F.lit(company_name).cast("string").alias("name"), F.col("company_domain").alias("domain"),
            F.lit(website).cast("string").alias("website"),
        ).alias("company"),
        F.col("contacts"),
    )
    return lists.withColumn("request_id", request).select(
        by, "part", "parts", "request_id", "company_domain", F.size("contacts").alias("contact_count"),
        F.to_json(body).alias("payload"),
    )


def pending_payloads(payloads: DataFrame, ledger: DataFrame) -> DataFrame:
    """Payloads not yet delivered."""
    return payloads.join(ledger.select("request_id").distinct(), "request_id", "left_anti")


def sync_ledger(payloads: DataFrame, ledger: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """One row: requests due and skipped, contacts accepted, duplicates, rejected.

    ``responses(request_id, accepted, duplicates, rejected)``; without an answer
    every contact of a due request counts as accepted.
    """
    done = ledger.select("request_id").distinct().withColumn("__done", F.lit(True))
    once = payloads.select("request_id", "contact_count").dropDuplicates(["request_id"]).join(done, "request_id", "left")
    due = F.col("__done").isNull()
    if responses is not None:
        once = once.join(responses, "request_id", "left")
        accepted, dup, rej = F.coalesce("accepted", "contact_count"), F.coalesce("duplicates", F.lit(0)), F.coalesce("rejected", F.lit(0))
    else:
        accepted, dup, rej = F.col("contact_count"), F.lit(0), F.lit(0)
    return once.agg(
        F.count_if(due).alias("sent"), F.count_if(~due).alias("skipped"),
        F.coalesce(F.sum(F.when(due, accepted)), F.lit(0)).cast("bigint").alias("accepted"),
        F.coalesce(F.sum(F.when(due, dup)), F.lit(0)).cast("bigint").alias("duplicates"),
        F.coalesce(F.sum(F.when(due, rej)), F.lit(0)).cast("bigint").alias("rejected"),
    )
