"""Composed contact jobs: full validation, page post-processing, batch scrape, site contacts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.functions import addresses as A
from contactlake.functions.text import strip_ws
from contactlake.operators import deliverability as M
from contactlake.operators import validation as V
from contactlake.operators.extraction import extract_contact_records, unique_contacts
from contactlake.operators.joins import lookup
from contactlake.operators.policy import url_safety
from contactlake.operators.privacy import redact_snippets
from contactlake.operators.suppression import check_suppression
from contactlake.session import ensure_checkpoint_dir


def validate_contacts(
    contacts: DataFrame,
    dns: DataFrame,
    tlds: Iterable[str] | None = None,
    disposable: DataFrame | None = None,
    compat: bool = False,
) -> DataFrame:
    """Static checks, then DNS facts for the rows that passed them."""
    checked = V.validate_static(contacts, tlds=tlds, disposable=disposable, compat=compat).withColumn(
        "domain", A.domain_of(F.col("email"))
    )
    # Each distinct domain is resolved once.  Domains of rejected rows come along:
    # leaving them out would run all static checks a second time just to know them.
    wanted = contacts.select(A.domain_of(F.col("email")).alias("domain"))
    facts = M.domain_facts(wanted, dns, compat)
    joined = M.mailbox_status(lookup(checked, facts, "domain"))
    resolved = F.col("mailbox_status").isin("deliverable", "risky")
    asked = F.col("passed") & ~F.col("is_disposable")
    return (
        joined.withColumn("is_null_mx", asked & F.coalesce("is_null_mx", F.lit(False)))
        .withColumn("valid", F.col("passed") & (F.col("mailbox_status") != "undeliverable"))
        .withColumn("mx_status", F.col("mailbox_status"))
        .withColumn(
            "mx_records",
            F.when(resolved, F.array("hostname")).otherwise(F.array().cast("array<string>")),
        )
        .withColumn(
            "mx_enrichment",
            F.when(resolved, F.struct("ip", "hostname", "priority", "country", "city", "isp", "asn")),
        )
        .drop("mx_hosts", "hostname", "priority", "ip", "isp", "asn", "country", "city", "has_mx", "has_a")
    )


def extraction_post_process(
    records: DataFrame, suppression: DataFrame, max_chars: int = 150, strip: bool = False, redact: bool = True
) -> DataFrame:
    """Attach the suppression verdict and the redacted snippet to every record."""
    return redact_snippets(check_suppression(records, suppression), "context_snippet", max_chars, strip, redact).drop(
        "matched_type", "matched_value"
    )


def scrape_batch(pages: DataFrame, urls: DataFrame, discovered_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcome per requested URL, contacts first seen): ``urls(url, ord)``.

    A URL counts as failed when it is empty, not http(s), unsafe, or absent
    from the snapshot.
    """
    asked = urls.select("ord", strip_ws(F.coalesce("url", F.lit(""))).alias("url"))
    judged = url_safety(asked).withColumn(
        "error",
        F.when(F.length("url") == 0, K.BATCH_EMPTY_URL)
        .when(~F.col("url").rlike("^https?://"), K.BATCH_PROTOCOL)
        .when(~F.col("safe"), F.concat(F.lit(K.BATCH_REJECTED), F.col("unsafe_reason"))),
    )
    # Used four times below: kept in the shared checkpoint folder instead of judged again.
    ensure_checkpoint_dir(urls.sparkSession)
    judged = judged.select("ord", "url", "error").checkpoint()
    wanted = judged.where(F.col("error").isNull()).select("url").distinct()
    hit_pages = pages.join(wanted, "url", "left_semi")
    records = extract_contact_records(hit_pages, discovered_at=discovered_at)
    counts = hit_pages.select("url").distinct().join(
        records.groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("n")), "url", "left"
    ).select("url", F.coalesce("n", F.lit(0)).alias("n"))
    outcome = lookup(judged, counts, "url").select(
        "ord", "url",
        (F.col("error").isNull() & F.col("n").isNotNull()).alias("success"),
        F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("email_count"),
        F.coalesce("error", F.when(F.col("n").isNull(), K.BATCH_ABSENT)).alias("error"),
    )
    first_ask = judged.where(F.col("error").isNull()).groupBy("url").agg(F.min("ord").alias("visit"))
    visited = records.join(first_ask.withColumnRenamed("url", "source_url"), "source_url")
    return outcome, unique_contacts(visited, ["visit", "ord"])
