"""Contact extraction over page and document corpora.

All per-page work stays inside the row (arrays and higher-order functions), so
extraction is a single scan without a shuffle; only cross-page deduplication
aggregates.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions import addresses as A
from contactlake.functions import text as T
from contactlake.operators.firsts import first_per_key

MAILTO_CONTEXT = "mailto link on page"
METADATA_CONTEXT = "Embedded in page metadata/scripts"


def deobfuscate(df: DataFrame, col: str = "text", out: str = "decoded") -> DataFrame:
    return df.withColumn(out, T.deobfuscate(F.col(col)))


def _valid(found: Column, tlds) -> Column:
    return F.filter(found, lambda e: A.has_valid_tld(e, tlds))


def _valid_distinct(found: Column, tlds) -> Column:
    return F.array_distinct(F.transform(_valid(found, tlds), A.normalise))


def extract_emails(
    df: DataFrame, id_col: str, col: str, tlds: Iterable[str] | None = None
) -> DataFrame:
    """(id, email): distinct valid addresses of each text."""
    decoded = df.where(T.may_contain_address(F.col(col))).select(id_col, T.deobfuscate(F.col(col)).alias("__t"))
    # Outer explode: the inner form would evaluate the whole chain a second time as a size filter.
    return decoded.select(
        id_col, F.explode_outer(_valid_distinct(T.find_addresses(F.col("__t")), tlds)).alias("email")
    ).where(F.col("email").isNotNull())


def page_text(df: DataFrame, col: str = "html") -> DataFrame:
    return df.withColumn("title", T.page_title(F.col(col))).withColumn("body_text", T.strip_markup(F.col(col)))


def context_snippets(df: DataFrame, text: str, email: str, radius: int = 50, out: str = "snippet") -> DataFrame:
    return df.withColumn(out, T.snippet(F.col(text), F.col(email), radius))


def extract_phones(df: DataFrame, id_col: str, col: str = "html", strict: bool = False) -> DataFrame:
    """(id, ord, phone): distinct phones in page order."""
    found = (T.phones_strict if strict else T.phones)(F.col(col))
    return df.select(id_col, F.posexplode_outer(found).alias("ord", "phone")).where(F.col("phone").isNotNull())


def contact_phone(phones: Column, context: Column) -> Column:
    """Phone printed next to the address, else the first of the page."""
    return T.let(
        phones,
        lambda ps: F.coalesce(F.get(F.filter(ps, lambda p: F.contains(context, p)), F.lit(0)), F.get(ps, F.lit(0))),
    )


def extract_socials(df: DataFrame, col: str = "html") -> DataFrame:
    return df.withColumn("socials", T.socials(F.col(col)))


def detect_job_titles(df: DataFrame, snippet: str, html: str | None = None) -> DataFrame:
    title = T.job_title(F.col(snippet))
    if html:
        title = F.coalesce(title, T.job_title(F.col(html)))
    return df.withColumn("job_title", title)


def infer_names(df: DataFrame, email: str = "email") -> DataFrame:
    """Name from the local part, not for role mailboxes; plus the export form."""
    e = F.col(email)
    return df.withColumn("name", F.when(~A.is_role_address(e), A.infer_name(e))).withColumn(
        "display_name", A.display_name(e)
    )


def classify_addresses(df: DataFrame, email: str = "email") -> DataFrame:
    e, d = F.col(email), A.part(F.lower(F.col(email)), 1)
    return (
        df.withColumn("type", F.when(A.is_role_address(e), "role").otherwise("personal"))
        .withColumn("is_disposable", A.is_disposable(d))
        .withColumn("email_category", A.category(e, d))
    )


def extract_contact_records(
    pages: DataFrame,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
    title: str | None = None,
    depth: str | None = None,
    discovered_at: Column | None = None,
    method: str = "http",
    tlds: Iterable[str] | None = None,
) -> DataFrame:
    """Contacts of each page: mailto links, visible text, then anything else.

    Output: the contact columns plus ``page_id`` and ``ord`` (order on the page).
    """
    src = pages.where(T.may_contain_address(F.col(html))).select(
        F.col(id_col).alias("page_id"),
        F.col(url).alias("source_url"),
        F.col(html).alias("__html"),
        (F.col(title) if title else F.lit(None).cast("string")).alias("__title"),
        (F.col(depth).cast("int") if depth else F.lit(0)).alias("depth"),
    )
    decoded = src.withColumn("__doc", T.deobfuscate(F.col("__html")))
    texted = decoded.withColumn("__text", T.strip_markup(F.col("__doc")))
    mailto = F.regexp_extract_all(
        F.col("__doc"),
        F.lit(r"""(?i)href=["']mailto:([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})[^"']*["']"""),
        F.lit(1),
    )
    tiers = texted.select(
        "*",
        _valid_distinct(mailto, tlds).alias("__mailto"),
        # Text and markup are decoded once more, as nested encodings require.
        _valid_distinct(T.find_addresses(T.deobfuscate(F.col("__text"))), tlds).alias("__visible"),
        _valid_distinct(T.find_addresses(T.deobfuscate(F.col("__doc"))), tlds).alias("__all"),
    )
    # What holds for the page is found once, before its addresses become rows; the HTML goes no further.
    page = F.col("__html")
    tiers = tiers.withColumn("__every", F.array_distinct(F.concat("__mailto", "__visible", "__all")))
    tiers = tiers.select(
        "page_id", "source_url", "depth", "__title", "__mailto", "__visible", "__every", "__text", "__doc",
        F.lower("__text").alias("__text_low"), F.length("__text").alias("__text_len"),
        F.lower("__doc").alias("__doc_low"), F.length("__doc").alias("__doc_len"),
        T.job_title(page).alias("__page_job"), T.phones(page).alias("__phones"), T.socials(page).alias("socials"),
        T.blank_to_null(T.page_title(page)).alias("__page_title"),
    )

    def context(seen: Column, e: Column, visible: Column, direct: Column) -> Column:
        around = T.snippet(F.col("__doc"), e, 40, F.col("__doc_low"), F.col("__doc_len"))
        raw = T.let(
            T.strip_ws(T.collapse_ws(F.regexp_replace(T.strip_tags(around), "(?i)&quot;", '"'))),
            lambda r: F.when(F.length(r) > 0, r).otherwise(METADATA_CONTEXT),
        )
        as_text = visible & (~direct | (F.length(seen) > 0))
        return F.struct(
            e.alias("email"),
            F.when(as_text, "text").when(direct, "mailto").otherwise("metadata").alias("context_type"),
            F.when(as_text, seen).when(direct, F.lit(MAILTO_CONTEXT)).otherwise(raw).alias("context"),
        )

    def hit(e: Column) -> Column:
        visible, direct = F.array_contains("__visible", e), F.array_contains("__mailto", e)
        seen = F.when(visible, T.snippet(F.col("__text"), e, 50, F.col("__text_low"), F.col("__text_len"))).otherwise(F.lit(""))
        return T.let(seen, lambda s: context(s, e, visible, direct))

    hits = tiers.select(
        "page_id", "source_url", "depth", "__title", "__page_job", "__phones", "socials", "__page_title",
        # Outer, as Spark would else decode every page twice to filter on the size of what it explodes.
        F.posexplode_outer(F.transform("__every", hit)).alias("ord", "hit"),
    ).where(F.col("hit").isNotNull())
    hits = hits.withColumn("__role", A.is_role_address(F.col("hit.email")))
    e, ctx, role = F.col("hit.email"), F.col("hit.context"), F.col("__role")
    return hits.select(
        "page_id",
        "ord",
        e.alias("email"),
        A.part(e, 1).alias("domain"),
        F.when(role, "role").otherwise("personal").alias("type"),
        F.when(~role, A.infer_name(e)).alias("name"),
        F.coalesce(T.job_title(ctx), F.col("__page_job")).alias("job_title"),
        contact_phone(F.col("__phones"), ctx).alias("phone"),
        "socials",
        F.lit("unverified").alias("mx_status"),
        "source_url",
        F.coalesce(T.blank_to_null(F.col("__title")), F.col("__page_title")).alias("page_title"),
        T.blank_to_null(ctx).alias("context_snippet"),
        F.col("hit.context_type").alias("context_type"),
        F.lit(method).alias("extraction_method"),
        "depth",
        (discovered_at if discovered_at is not None else F.current_timestamp()).alias("discovered_at"),
        F.struct(
            F.lit(True).alias("syntax"), F.lit(True).alias("tld"), A.is_disposable(A.part(e, 1)).alias("is_disposable")
        ).alias("validity"),
    )


def unique_contacts(records: DataFrame, order: list[str | Column]) -> DataFrame:
    """First record of every address in visit order."""
    return first_per_key(records, ["email"], order)
