"""Crawl frontier over a link table, site contacts and crawl reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.functions import urls as U
from contactlake.operators.firsts import first_per_key
from contactlake.operators.ordering import ranked
from contactlake.session import ensure_checkpoint_dir


# Steps between two compactions of the settled pages.
COMPACT = 8


def _walk(start: DataFrame, edges: DataFrame, max_depth: int | None) -> DataFrame:
    """(url, depth): the least sum of ``cost`` (0 or 1) on a way from ``start(url)`` over ``edges(src, dst, cost)``.

    A step follows every edge of the pages that the last one reached, or reached at less depth, so edges without
    cost need no steps of their own.  No step fixes its number of tasks: adaptive execution deals small steps to few.
    """

    def least(pages: DataFrame) -> DataFrame:
        return pages.groupBy("url").agg(F.min("depth").alias("depth"))

    edges = edges.repartition("src").checkpoint(eager=True)
    fresh = least(start.withColumn("depth", F.lit(0))).checkpoint(eager=True)
    settled = [fresh]
    while not fresh.isEmpty():
        if len(settled) > COMPACT:
            # One input instead of one per step, so that a walk of any depth keeps a short plan.
            settled = [least(reduce(DataFrame.unionByName, settled)).checkpoint(eager=True)]
        found = edges.join(fresh.withColumnRenamed("url", "src"), "src").select(
            F.col("dst").alias("url"), (F.col("depth") + F.col("cost")).alias("depth")
        )
        found = least(found if max_depth is None else found.where(F.col("depth") <= max_depth))
        known = reduce(DataFrame.unionByName, settled).select(F.col("url").alias("__url"), F.col("depth").alias("__depth"))
        better = (F.col("url") == F.col("__url")) & (F.col("__depth") <= F.col("depth"))
        fresh = found.join(known, better, "left_anti").checkpoint(eager=True)
        settled.append(fresh)
    return least(reduce(DataFrame.unionByName, settled))


def crawl_frontier(
    seeds: DataFrame,
    links: DataFrame,
    max_depth: int | None = None,
    max_pages: int | None = None,
    same_domain: bool = True,
    allowed: DataFrame | None = None,
    canonical: DataFrame | None = None,
) -> DataFrame:
    """(site, url, depth, priority, visit_rank): pages a crawl from the seeds visits.

    ``seeds(url)``, ``links(src, dst)``; ``allowed(url, allowed)`` holds robots
    verdicts; ``canonical(src, dst)`` edges do not add depth.  Depth is the
    shortest link distance, up to ``max_depth`` (None: to the end of the graph);
    visits go by priority, depth, url, up to ``max_pages`` per site.  Priority is
    known only at the end, so the page cap bounds the result, not the walk.

    Links that lead to another site or to a refused page are left out once, before the walk.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    edges = links.select("src", "dst", F.lit(1).alias("cost"))
    if canonical is not None:
        edges = edges.unionByName(canonical.select("src", "dst", F.lit(0).alias("cost")))
    edges = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    start = seeds.select("url").distinct()
    if same_domain:
        edges = edges.where(U.host(F.col("src")) == U.host(F.col("dst")))
    if allowed is not None:
        blocked = allowed.where(~F.col("allowed")).select("url").distinct()
        edges = edges.join(blocked.withColumnRenamed("url", "dst"), "dst", "left_anti").select("src", "dst", "cost")
        start = start.join(blocked, "url", "left_anti")
    site = U.host(F.col("url")) if same_domain else F.lit("*")
    visited = _walk(start, edges, max_depth).select(site.alias("site"), "url", "depth")
    found = visited.withColumn("priority", U.is_priority(F.col("url")) | (F.col("depth") == 0))
    # The page cap is the feature: it bounds what one crawl visits.
    order = [F.col("priority").desc(), F.col("depth"), F.col("url")]
    return ranked(found, ["site"], order, "visit_rank", max_pages)


def checked_limits(max_depth: int | None = None, max_pages: int | None = None) -> tuple[int, int]:
    """Depth in 1..10 (default 2) and pages in 1..200 (default 30), as a crawl request may ask for."""
    depth, pages = 2 if max_depth is None else max_depth, 30 if max_pages is None else max_pages
    if not 1 <= depth <= 10 or not 1 <= pages <= 200:
        raise ValueError(f"depth {depth} is not in 1..10 or pages {pages} not in 1..200")
    return depth, pages


def site_contacts(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """First record of every address per site, in visit order, with the page's depth."""
    visits = frontier.select("site", F.col("url").alias("source_url"), F.col("depth").alias("__depth"), "visit_rank")
    joined = records.join(visits, "source_url").withColumn("depth", F.col("__depth")).drop("__depth")
    return first_per_key(joined, ["site", "email"], ["visit_rank", "ord"])


def crawl_report(fetch_log: DataFrame, records: DataFrame) -> DataFrame:
    """Per job: pages visited, skipped and failed, retries, unique contacts, access reason.

    ``fetch_log(job_id, status, category, reason, url[, attempt, skipped])``.
    """
    ok = F.col("category") == "SUCCESS"
    skipped = F.col("skipped") if "skipped" in fetch_log.columns else F.lit(False)
    retries = F.sum("attempt") if "attempt" in fetch_log.columns else F.sum(F.lit(0))
    pages = fetch_log.groupBy("job_id").agg(
        F.count_if(~skipped).alias("pages_visited"),
        F.count_if(skipped).alias("pages_skipped"),
        F.count_if(~ok & ~skipped).alias("pages_failed"),
        retries.cast("bigint").alias("retries"),
        # The last refusal in log order names the reason.
        F.max_by("reason", F.when(F.col("category") == "ACCESS_RESTRICTED", F.col("seq"))).alias("__reason"),
        F.max(F.col("category") == "ACCESS_RESTRICTED").alias("__refused"),
    )
    unique = records.groupBy("job_id", "email").agg(F.min("domain").alias("domain"), F.min("type").alias("type"))
    contacts = unique.groupBy("job_id").agg(
        F.count("*").alias("unique_emails"),
        F.count_distinct("domain").alias("unique_domains"),
        F.count_if(F.col("type") == "role").alias("role_count"),
        F.count_if(F.col("type") == "personal").alias("personal_count"),
    )
    out = pages.join(contacts, "job_id", "left").withColumn(
        "access_restricted_reason", F.when(F.col("__refused"), F.col("__reason"))
    )
    return out.drop("__reason", "__refused").fillna(
        0, ["unique_emails", "unique_domains", "role_count", "personal_count"]
    )
