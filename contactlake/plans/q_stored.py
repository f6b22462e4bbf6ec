"""Registered queries on datasets that are stored with an index or with counts per day."""

import uuid
from datetime import date, timedelta

from pyspark.sql import functions as F

from contactlake.operators import daily_counts, search_index
from contactlake.plans import q_datasets  # noqa: F401  the same SQL serves here
from contactlake.plans import seeds as S
from contactlake.plans.registry import ORACLE, query
from contactlake.session import shared_dir

ADDITIONS = 3


def _new_folder(spark, label):
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _days(spark, sf):
    """A folder of counts of all contacts, added in parts as if they were days."""
    path = _new_folder(spark, "daily-counts")
    rows = S.rich_contacts(spark, sf, "lineitem", S.MIXED_EMAIL)
    for n in range(ADDITIONS):
        daily_counts.add_day(rows.where(F.col("contact_id") % ADDITIONS == n), path, date(2024, 2, 28) + timedelta(days=n))
    return path


@query("a8_daily_kpis", ORACLE["a8_contact_kpis"])
def a8_daily(spark, sf):
    return daily_counts.kpis(spark, _days(spark, sf))


@query("a9_daily_facets", ORACLE["a9_domain_facets"])
def a9_daily(spark, sf):
    return daily_counts.facets(spark, _days(spark, sf))


@query("a10_search_index", ORACLE["a10_search_contacts"])
def a10_index(spark, sf):
    path = _new_folder(spark, "search-index")
    rich = q_datasets._rich(spark, sf)
    for n in range(ADDITIONS):
        search_index.add_to_index(rich.where(F.col("contact_id") % ADDITIONS == n), path, f"part-{n}", block_rows=4096)
    found = {
        "session": search_index.search_index(spark, path, "IN", "session", type_="role", domain="gmail.com"),
        "directory": search_index.search_index(spark, path, "Doe", "directory"),
        "results": search_index.search_index(spark, path, "team", "results", category="Personal", status="invalid", job="3"),
    }
    out = None
    for form, rows in found.items():
        part = rows.select(F.lit(form).alias("form"), "contact_id")
        out = part if out is None else out.unionByName(part)
    return out
