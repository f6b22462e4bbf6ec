"""Contact datasets: merge, quarantine, segment, search, page, aggregate; job tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.functions.text import strip_ws
from contactlake.operators.firsts import first_per_key
from contactlake.operators.ordering import ranked, running


def upsert_folder(existing: DataFrame, incoming: DataFrame, cap: int | None = None) -> DataFrame:
    """Last write wins per lower(email); first position kept; at most ``cap`` per folder if given.

    Both need folder_id, email, pos (order within their side).
    """
    both = existing.withColumn("__src", F.lit(0)).unionByName(incoming.withColumn("__src", F.lit(1)))
    both = both.where(F.length("email") > 0)
    row = F.struct(*[F.col(c) for c in existing.columns if c != "pos"])
    at = F.struct("__src", "pos")
    merged = both.groupBy("folder_id", F.lower("email").alias("__key")).agg(
        F.max_by(row, at).alias("__row"), F.min(at).alias("__at")
    )
    placed = merged.select("__row.*", F.col("__at.__src").alias("src_"), F.col("__at.pos").alias("pos_"))
    order = [F.col("src_"), F.col("pos_"), F.col("email")]
    return ranked(placed, ["folder_id"], order, "pos", cap).drop("src_", "pos_")


def merge_session(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """First write wins per lower(email).  Both need email, pos."""
    both = existing.withColumn("__src", F.lit(0)).unionByName(incoming.withColumn("__src", F.lit(1)))
    return first_per_key(both, [F.lower("email")], ["__src", "pos"]).drop("__src")


def folder_counts(folders: DataFrame, records: DataFrame) -> DataFrame:
    """Records per folder, empty folders included."""
    counts = records.groupBy("folder_id").agg(F.count("*").alias("__n"))
    return folders.join(counts, "folder_id", "left").withColumn("count", F.coalesce("__n", F.lit(0))).drop("__n")


def clean_folder_name(c: Column) -> Column:
    return F.substring(strip_ws(c), 1, 100)


def create_folders(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """Folders plus the new names; names compare without case.  wanted(folder_id, name, ord)."""
    named = wanted.withColumn("name", clean_folder_name(F.col("name"))).where(F.length("name") > 0)
    unique = first_per_key(named.withColumn("__k", F.lower("name")), ["__k"], ["ord"])
    known = folders.select(F.lower("name").alias("__k")).distinct()
    fresh = unique.join(known, "__k", "left_anti").select(*folders.columns)
    return folders.unionByName(fresh)


def delete_folders(folders: DataFrame, ids: DataFrame) -> DataFrame:
    return folders.join(ids.select("folder_id").distinct(), "folder_id", "left_anti")


def remove_records(records: DataFrame, removals: DataFrame) -> DataFrame:
    """Drop (folder_id, email) pairs, e-mail case ignored."""
    gone = removals.select("folder_id", F.lower("email").alias("__e")).distinct()
    return records.withColumn("__e", F.lower("email")).join(gone, ["folder_id", "__e"], "left_anti").drop("__e")


def quarantine(contacts: DataFrame, statuses: tuple[str, ...] = ("undeliverable",)) -> tuple[DataFrame, DataFrame]:
    """(kept, dead) by deliverability status."""
    dead = F.coalesce(F.col("mx_status").isin(*statuses), F.lit(False))
    return contacts.where(~dead), contacts.where(dead)


def quarantine_to(contacts: DataFrame, kept_path: str, quarantine_path: str, statuses=("undeliverable",)) -> None:
    """Persist the dead rows first; only then write the rows that stay."""
    kept, dead = quarantine(contacts, statuses)
    dead.write.mode("append").parquet(quarantine_path)
    kept.write.mode("overwrite").parquet(kept_path)


def _segment_tests() -> dict[str, Column]:
    status, risky = F.col("mx_status"), F.coalesce(F.col("is_catch_all"), F.lit(False))
    clean = (status == "deliverable") & ~risky
    bad = status.isin("undeliverable", "disposable")
    at_risk = (status == "risky") | risky
    return {
        "clean": clean, "deliverable": clean,
        "suppression": bad, "bad": bad, "blacklist": bad,
        "risky": at_risk, "catch-all": at_risk, "catchall": at_risk,
        "all": F.lit(True),
        "personal": F.col("type") == "personal", "role": F.col("type") == "role",
        "undeliverable": status == "undeliverable", "disposable": status == "disposable",
    }


def segment_meta(name: str) -> tuple[str, str]:
    """(file prefix, label) of a segment; unknown names raise."""
    norm = (name or "all").lower()
    for aliases, prefix, label in K.SEGMENTS:
        if norm in aliases:
            return prefix, label
    if norm in _segment_tests():
        return f"{norm}_leads", f"{norm.capitalize()} Leads"
    raise ValueError(f"unknown segment: {name}")


def segment(contacts: DataFrame, name: str = "all") -> DataFrame:
    segment_meta(name)
    return contacts.where(F.coalesce(_segment_tests()[(name or "all").lower()], F.lit(False)))


def segment_counts(contacts: DataFrame) -> DataFrame:
    """One row; the segments overlap."""
    t = _segment_tests()
    return contacts.agg(
        F.count_if(t["clean"]).alias("clean"),
        F.count_if(t["bad"]).alias("suppression"),
        F.count_if(t["risky"]).alias("risky"),
        F.count("*").alias("all"),
    )


def contact_kpis(contacts: DataFrame, approximate: bool = False) -> DataFrame:
    domains = F.approx_count_distinct("domain") if approximate else F.count_distinct("domain")
    return contacts.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("type") == "personal").alias("personal"),
        F.count_if(F.col("type") == "role").alias("role"),
        domains.alias("domains"),
        F.count_if(F.col("mx_status") == "deliverable").alias("deliverable"),
    )


def domain_facets(contacts: DataFrame) -> DataFrame:
    return contacts.where(F.length("domain") > 0).groupBy("domain").agg(F.count("*").alias("count")).orderBy("domain")


SEARCH_FIELDS = {
    "session": ("email", "domain", "page_title", "context_snippet"),
    "directory": ("email", "name", "domain"),
    "results": ("email", "domain", "name", "source_url"),
}


def search_contacts(
    contacts: DataFrame, query: str | None = None, fields: str = "session", type_: str | None = None,
    category: str | None = None, domain: str | None = None, status: str | None = None, job: str | None = None,
) -> DataFrame:
    """Substring search over a field set, and exact filters; null jobs pass the job filter."""
    out = contacts
    if type_ == "deliverable":
        out = out.where(F.col("mx_status") == "deliverable")
    elif type_:
        out = out.where(F.col("type") == type_)
    if category:
        guess = F.when(F.col("type") == "personal", "Personal").otherwise("General")
        out = out.where(F.lower(F.coalesce("email_category", guess)) == category.lower())
    if domain:
        out = out.where(F.col("domain") == domain)
    if status in ("verified", "invalid"):
        ok = F.coalesce(F.col("mx_status") == "deliverable", F.lit(False))
        out = out.where(ok if status == "verified" else ~ok)
    elif status:
        out = out.where(F.col("mx_status") == status)
    if job:
        out = out.where(F.col("job_id").isNull() | (F.col("job_id") == job))
    if query and query.strip():
        q = F.lit(query.lower())
        hit = F.lit(False)
        for field in SEARCH_FIELDS[fields]:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(field)), q), F.lit(False))
        out = out.where(hit)
    return out


def page_of(
    df: DataFrame, order: list[str], page: int = 1, size: int = 25, deep: bool = False, total: int | None = None
) -> DataFrame:
    """One page of a stable order, with page and total_pages; out-of-range pages clamp.

    ``order`` must be unique.  A page is a top-k over everything before it; with
    ``deep`` it is cut out by running row numbers over ranges instead, so no task
    sorts the rows before it.  A caller that turns pages gives the ``total`` it
    has counted once, or asks for the rows after the last one (``page_after``).
    """
    total = df.count() if total is None else total
    pages = max(1, -(-total // size))
    page = min(max(page, 1), pages)
    skip = (page - 1) * size
    if deep:
        numbered = running(df, [], [F.col(c) for c in order], row_number="row_")
        rows = numbered.where((F.col("row_") > skip) & (F.col("row_") <= skip + size)).drop("row_")
    else:
        rows = df.orderBy(*order).offset(skip).limit(size)
    return rows.withColumn("page", F.lit(page)).withColumn("total_pages", F.lit(pages))


def page_after(df: DataFrame, order: list[str], last: Sequence | None = None, size: int = 25) -> DataFrame:
    """The next rows after the one whose ``order`` values are ``last`` (None: the first rows); nothing is counted.

    ``order`` must be unique and is ascending, nulls first.  A page costs one filter and a top-k of its own size.
    """
    if last is not None:
        after, same = F.lit(False), F.lit(True)
        for name, value in zip(order, last, strict=True):
            c = F.col(name)
            beyond = c.isNotNull() if value is None else c > F.lit(value)
            after, same = after | (same & F.coalesce(beyond, F.lit(False))), same & c.eqNullSafe(F.lit(value))
        df = df.where(after)
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(size)


def select_contacts(contacts: DataFrame, selected: DataFrame) -> DataFrame:
    return contacts.join(selected.select("email").distinct(), "email", "left_semi")


def export_field(key: str) -> tuple[Column, str]:
    """(column, label) of an export field key."""
    for name, column, label in K.EXPORT_FIELDS:
        if name == key:
            return F.col(column), label
    return F.col(key), key


def project_fields(contacts: DataFrame, fields: list[str] | None = None, labels: bool = True) -> DataFrame:
    """Chosen export fields in the given order; none chosen means the default set."""
    chosen = list(fields) if fields else list(K.DEFAULT_EXPORT_FIELDS)
    picked = [(key, *export_field(key)) for key in chosen]
    return contacts.select(*[c.alias(label if labels else key) for key, c, label in picked])


def list_jobs(jobs: DataFrame, owner: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest jobs first, the first ``limit`` if given."""
    mine = jobs if owner in (None, "all") else jobs.where(F.col("owner") == owner)
    mine = mine.orderBy(F.col("started_at").desc(), F.col("job_id").desc())
    return mine if limit is None else mine.limit(limit)


def job_metrics(jobs: DataFrame) -> DataFrame:
    statuses = ("queued", "running", "completed", "cancelled", "failed")
    return jobs.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses],
        F.count_if(F.col("status").isin("completed", "cancelled", "failed")).alias("total_processed"),
    )


def recover_stale(jobs: DataFrame, now: Column) -> DataFrame:
    """In-flight jobs after a restart: queued again while retries last, else failed."""
    stale = F.col("status").isin("running", "queued")
    again = stale & (F.col("retry_count") < F.col("max_retries"))
    out = jobs.select("*", stale.alias("__stale"), again.alias("__again"))
    return (
        out.withColumn("status", F.when(F.col("__again"), "queued").when(F.col("__stale"), "failed").otherwise(F.col("status")))
        .withColumn("retry_count", F.col("retry_count") + F.col("__again").cast("int"))
        .withColumn(
            "error_message",
            F.when(F.col("__again"), K.RECOVERED)
            .when(F.col("__stale"), K.NOT_RECOVERED)
            .otherwise(F.col("error_message") if "error_message" in jobs.columns else F.lit(None).cast("string")),
        )
        .withColumn(
            "ended_at",
            F.when(F.col("__again"), F.lit(None).cast("timestamp")).when(F.col("__stale"), now).otherwise(F.col("ended_at")),
        )
        .withColumn("recovered", F.col("__stale"))
        .drop("__stale", "__again")
    )


def concurrency_profile(
    jobs: DataFrame, per_user: int = 3, overall: int = 10, browser_per_user: int = 2, ranges: int | None = None
) -> DataFrame:
    """Active jobs after every start and end, and which limits are exceeded.

    ``jobs(job_id, owner, started_at, ended_at[, is_browser])``.  Ends come
    before starts of the same instant.  Running jobs have no end.
    """
    browser = F.col("is_browser") if "is_browser" in jobs.columns else F.lit(False)
    base = jobs.where(F.col("started_at").isNotNull()).select("job_id", "owner", "started_at", "ended_at", browser.alias("is_browser"))
    moves = F.array(
        F.struct(F.col("started_at").alias("at"), F.lit(1).alias("delta")),
        F.struct(F.col("ended_at").alias("at"), F.lit(-1).alias("delta")),
    )
    events = base.select("job_id", "owner", "is_browser", F.explode(moves).alias("m")).select(
        "job_id", "owner", "is_browser", "m.at", "m.delta"
    ).where(F.col("at").isNotNull())
    order = [F.col("at"), F.col("delta"), F.col("job_id")]
    step = F.col("delta").cast("long")
    everyone = running(events, [], order, sums={"global_active": step}, ranges=ranges)
    out = running(
        everyone, ["owner"], order,
        sums={"user_active": step, "user_browser_active": F.when(F.col("is_browser"), step).otherwise(F.lit(0))},
        ranges=ranges,
    )
    return (
        out.withColumn("over_user", F.col("user_active") > per_user)
        .withColumn("over_global", F.col("global_active") > overall)
        .withColumn("over_browser", F.col("user_browser_active") > browser_per_user)
    )
