"""WARC: what a not-modified revisit stood for.

A server that answers "not modified" sends no body; the archive keeps a revisit
record.  Each one is joined, as of its time, to the latest strictly earlier full
response of the same canonical URL, its validators are compared with that
response's, and the headers that a 304 may update replace the stored ones.

Outcomes: ``resolved`` (validators agree), ``unvalidated`` (the revisit carries
none; resolved by time alone), ``mismatch`` (they differ; not resolved),
``missing`` (no earlier response).

Scale: the as-of join is a running maximum over (URL, time) ranges of narrow
rows, so a URL with any share of all captures spans many tasks; payloads never
move, only digests do.  Headers come by one join on the response's id.

Nulls: a null URL is a URL of its own; null headers are none; a revisit without
a time has outcome ``missing``, a response without one is never used.  Repeated
header names are kept as they are.  Of responses at one time the greatest id
counts.  Repeated rows are answered each.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.llm.common import materialise
from contactlake.operators.ordering import running

# Header fields of a 304 that update the stored response (RFC 9110, 15.4.5, and its validators).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)="


def canonical_url(url: Column) -> Column:
    """Host, path and ordered query of a URL, without what does not name another resource.

    Dropped: scheme, user, default port, a leading ``www.``, final slashes,
    fragment, tracking parameters.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    params = F.sort_array(F.filter(params, lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.array_join(params, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """The first value of a header field, trimmed; null if absent."""
    return F.trim(F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"])


def merged_headers(stored: Column, update: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """Stored fields that the update does not replace, then its permitted fields."""
    fresh = F.filter(update, lambda h: F.lower(h["name"]).isin(*permitted))
    names = F.transform(fresh, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"]))), fresh)


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """One row per revisit of records (record_id, kind, url, captured_at, headers, payload_sha256, payload_chars).

    ``kind`` is ``response`` or ``revisit``, ``headers`` array<struct<name, value>>.
    """
    none = F.array().cast("array<struct<name:string,value:string>>")
    held = materialise(
        records.select(
            "record_id", "kind", F.coalesce(canonical_url(F.col("url")), F.lit("")).alias("url_key"), "captured_at",
            F.coalesce("headers", none).alias("headers"), "payload_sha256", "payload_chars",
        ), "captures",
    )
    etag = F.regexp_replace(header(F.col("headers"), "etag"), "^W/", "")
    modified = header(F.col("headers"), "last-modified")
    response = F.col("kind") == "response"
    narrow = held.select("record_id", "kind", "url_key", "captured_at", etag.alias("etag"), modified.alias("modified"))
    # At one time revisits come first, so that a response only answers for later ones.
    order = [F.col("captured_at").asc_nulls_first(), response.asc(), F.col("record_id").asc()]
    dated = F.when(
        response & F.col("captured_at").isNotNull(),
        F.struct("captured_at", "record_id", F.col("etag").alias("stored_etag"), F.col("modified").alias("stored_modified")),
    )
    asof = running(narrow, ["url_key"], order, maxima={"latest": dated}).where(F.col("kind") == "revisit")
    outcome = (
        F.when(F.col("latest").isNull(), "missing")
        .when(F.col("etag").isNotNull(), F.when(F.col("etag") == F.col("latest.stored_etag"), "resolved").otherwise("mismatch"))
        .when(F.col("modified").isNotNull(), F.when(F.col("modified") == F.col("latest.stored_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    matched = asof.select(
        F.col("record_id").alias("revisit_id"), F.col("captured_at").alias("__at"), outcome.alias("outcome"),
        F.col("latest.record_id").alias("response_id"),
    )
    found = F.col("outcome").isin("resolved", "unvalidated")
    stored = held.where(response).dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("__rid"), F.col("headers").alias("__stored"), "payload_sha256", "payload_chars"
    )
    update = held.where(F.col("kind") == "revisit").dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("__vid"), F.col("headers").alias("__update")
    )
    joined = matched.join(update, matched["revisit_id"].eqNullSafe(update["__vid"]), "left")
    # Unresolved revisits keep their own id as key, so that they do not meet in one task; they match nothing.
    joined = joined.withColumn("__found", found).withColumn("__want", F.when(found, F.col("response_id")).otherwise(F.col("revisit_id")))
    joined = joined.join(stored, (joined["__want"] == stored["__rid"]) & joined["__found"], "left")
    return joined.select(
        "revisit_id", "outcome", F.when(F.col("__found"), F.col("response_id")).alias("response_id"),
        F.when(found, merged_headers(F.col("__stored"), F.coalesce("__update", none), permitted)).alias("headers"),
        "payload_sha256", "payload_chars",
    )
