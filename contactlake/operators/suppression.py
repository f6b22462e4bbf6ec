"""Suppression lists: matching, filtering, merging, viewing, erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions import addresses as A
from contactlake.functions.text import strip_ws
from contactlake.operators import bloom
from contactlake.operators.firsts import first_per_key, last_per_key
from contactlake.operators.joins import lookup
from contactlake.session import ensure_checkpoint_dir

# fixed values: request reason -> stored reason
REASONS = {
    "unsubscribe": "UNSUBSCRIBE", "bounce": "BOUNCE", "complaint": "COMPLAINT",
    "manual": "MANUAL", "legal": "LEGAL_REQUEST", "dnc": "DO_NOT_CONTACT",
    "do_not_contact": "DO_NOT_CONTACT", "legal_request": "LEGAL_REQUEST",
}


def space_of(kind: Column) -> Column:
    """Both hash types share one key space."""
    return F.when(kind.isin("sha256", "md5"), "hash").otherwise(kind)


def clean_value(kind: Column, value: Column) -> Column:
    low = A.normalise(value)
    return F.when(kind == "domain", F.regexp_replace(low, "^@", "")).otherwise(low)


def _index(suppression: DataFrame) -> DataFrame:
    """(space, key, reason, value): the newest entry per key."""
    order = [c for c in ("created_at", "id") if c in suppression.columns] or ["value"]
    keyed = suppression.select(
        space_of(F.col("type")).alias("space"),
        clean_value(F.col("type"), F.col("value")).alias("key"),
        "reason", "value", *[c for c in order if c != "value"],
    )
    return last_per_key(keyed, ["space", "key"], order).select("space", "key", "reason", "value")


# kind of match by precedence
KINDS = ("email", "domain", "sha256", "md5")


def _forms(emails: DataFrame, spaces: set[str]) -> DataFrame:
    """(email, rank, space, key): the ways in which a list with these key spaces may name an address."""
    e = F.col("email")
    keys = [("email", e), ("domain", A.part(e, 1)), ("hash", F.sha2(e, 256)), ("hash", F.md5(e))]
    forms = [
        F.struct(F.lit(rank).alias("rank"), F.lit(space).alias("space"), key.alias("key"))
        for rank, (space, key) in enumerate(keys) if space in spaces
    ]
    if not forms:
        return emails.limit(0).select("email", F.lit(0).alias("rank"), F.lit("").alias("space"), F.lit("").alias("key"))
    return emails.select("email", F.inline(F.array(*forms))).where(F.col("key") != "")


def _possible(forms: DataFrame, suppression: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Rows of ``_forms`` that the list may hold; certain misses are left out without a shuffle.

    A filter takes the list's keys with their spaces; where it would be too large, all rows stay.
    """
    blocks = bloom.blocks_for(sum(counts.values()))
    if blocks * bloom.BITS // 8 > bloom.MAX_BYTES:
        return forms
    tagged = F.concat("space", F.lit(":"), "key")
    entries = suppression.select(space_of(F.col("type")).alias("space"), clean_value(F.col("type"), F.col("value")).alias("key"))
    words = bloom.bloom_words(entries.select(tagged.alias("k")), "k", blocks).checkpoint(eager=True)
    return bloom.may_contain(forms, words, tagged, blocks, "__may").where("__may").drop("__may")


def _named(contacts: DataFrame, suppression: DataFrame, email: str, prefilter: bool) -> DataFrame:
    """Distinct forms of the contacts' addresses in the spaces that the list holds; the others cost nothing."""
    counts = {r.space: r.n for r in suppression.groupBy(space_of(F.col("type")).alias("space")).agg(F.count("*").alias("n")).collect()}
    emails = contacts.select(A.normalise(F.col(email)).alias("email")).where(F.col("email") != "")
    if not prefilter:
        return _forms(emails.distinct(), set(counts))
    ensure_checkpoint_dir(contacts.sparkSession)
    return _possible(_forms(emails, set(counts)), suppression, counts).distinct()


def _matches(forms: DataFrame, suppression: DataFrame) -> DataFrame:
    """Suppressed addresses with reason and matched entry; precedence: email, domain, sha256, md5.

    Works on the narrow forms of distinct addresses, so neither repeated contacts nor wide records are shuffled.
    All forms meet the list in one join, so the list is read once and a task holds a share of all its kinds.
    """
    hits = lookup(forms, _index(suppression), ["space", "key"], "inner").select(
        F.col("email").alias("__email"), "rank", F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("rank")).alias("matched_type"), "reason",
        F.when(F.col("space") == "hash", F.col("key")).otherwise(F.col("value")).alias("matched_value"),
    )
    return first_per_key(hits, ["__email"], ["rank"]).drop("rank")


def check_suppression(contacts: DataFrame, suppression: DataFrame, email: str = "email", prefilter: bool = False) -> DataFrame:
    """Flag every contact: is_suppressed, suppression_reason, matched_type, matched_value.

    ``prefilter`` tests every address against a Bloom filter of the list before addresses are shuffled: the
    same result, worth its cost where few addresses are listed and contacts are many.
    """
    hits = _matches(_named(contacts, suppression, email, prefilter), suppression).select(
        "__email", F.col("reason").alias("suppression_reason"), "matched_type", "matched_value"
    )
    base = contacts.drop("is_suppressed", "suppression_reason").withColumn("__email", A.normalise(F.col(email)))
    return lookup(base, hits, "__email").withColumn("is_suppressed", F.col("matched_type").isNotNull()).drop("__email")


def filter_suppressed(contacts: DataFrame, suppression: DataFrame, email: str = "email", prefilter: bool = False) -> DataFrame:
    """Contacts that no entry matches; ``prefilter`` as in ``check_suppression``.

    Which entry matches does not matter here, so keys alone meet and nothing is ranked.
    """
    keys = suppression.select(space_of(F.col("type")).alias("space"), clean_value(F.col("type"), F.col("value")).alias("key")).distinct()
    hits = lookup(_named(contacts, suppression, email, prefilter), keys, ["space", "key"], "left_semi").select(F.col("email").alias("__email"))
    base = contacts.withColumn("__email", A.normalise(F.col(email)))
    # A list may match most contacts; the size that Spark expects from the files' sizes is far too low to broadcast by.
    return lookup(base, hits.hint("merge"), "__email", "left_anti").drop("__email")


def normalise_reason(c: Column) -> Column:
    return F.coalesce(A.lookup(REASONS, F.lower(c)), F.upper(c), F.lit("MANUAL"))


def merge_suppression(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing entries plus the new keys of ``incoming``, flagged ``is_new``.

    Both need id, type, value, reason; ``incoming`` also ``ord`` (arrival order).
    """
    old = existing.select("id", "type", "value", "reason").withColumn("is_new", F.lit(False))
    fresh = incoming.select(
        "id", "type", clean_value(F.col("type"), F.col("value")).alias("value"),
        normalise_reason(F.col("reason")).alias("reason"), "ord",
    )
    keyed = fresh.withColumn("__space", space_of(F.col("type")))
    unique = first_per_key(keyed, ["__space", "value"], ["ord"]).drop("ord")
    known = old.select(
        space_of(F.col("type")).alias("__space"), clean_value(F.col("type"), F.col("value")).alias("value")
    ).distinct()
    added = unique.join(known, ["__space", "value"], "left_anti").drop("__space")
    return old.unionByName(added.withColumn("is_new", F.lit(True)))


def merge_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: entries added, and incoming entries that were already known."""
    added = merge_suppression(existing, incoming).where("is_new").select(F.lit(1).alias("__new"))
    offered = incoming.select(F.lit(0).alias("__new"))
    return added.unionByName(offered).agg(
        F.count_if(F.col("__new") == 1).alias("added"),
        (F.count_if(F.col("__new") == 0) - F.count_if(F.col("__new") == 1)).alias("existing"),
    )


def suppression_view(suppression: DataFrame, user: str | None = None, is_admin: bool = False) -> DataFrame:
    """Own and global entries; everything for admins."""
    if is_admin or user is None:
        return suppression
    return suppression.where(F.col("added_by").isNull() | (F.col("added_by") == user))


def remove_suppression(
    suppression: DataFrame, ids: DataFrame, user: str | None = None, is_admin: bool = False
) -> DataFrame:
    """Drop entries by id; entries owned by someone else stay."""
    removable = suppression.join(ids.select("id").distinct(), "id", "left_semi")
    if not is_admin and user is not None:
        removable = removable.where(F.col("added_by").isNull() | (F.col("added_by") == user))
    return suppression.join(removable.select("id"), "id", "left_anti")


def _erase_keys(erase: DataFrame) -> DataFrame:
    return erase.select(A.normalise(F.col("email")).alias("__email")).distinct()


def _keyed(records: DataFrame) -> DataFrame:
    return records.withColumn("__email", strip_ws(F.lower("email")))


def forget_email(folder_records: DataFrame, erase: DataFrame) -> DataFrame:
    """Folder records without the addresses to be erased."""
    return lookup(_keyed(folder_records), _erase_keys(erase), "__email", "left_anti").drop("__email")


def forget_report(folder_records: DataFrame, erase: DataFrame) -> DataFrame:
    """Deleted rows per affected folder."""
    return (
        lookup(_keyed(folder_records), _erase_keys(erase), "__email", "left_semi")
        .groupBy("folder_id")
        .agg(F.count("*").alias("deleted_records"))
    )
