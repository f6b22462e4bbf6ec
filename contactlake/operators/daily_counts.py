"""Contact counts kept per day (A8, A9 on a dataset that grows).

A day is counted once, when it is added; totals over all days come from the stored counts alone.
Counts per domain are exact.  The number of distinct domains is exact from the stored domains, or
comes from one mergeable sketch per day (relative standard error 1.04 / sqrt(2^k), 0.8 % at k = 14),
where even the stored domains are too many to count at every look.

A day that is added again replaces its counts, so a cut-off addition is simply repeated.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKETCH_K = 14
_COUNTS = ("total", "personal", "role", "deliverable")


def add_day(contacts: DataFrame, path: str, day: date, sketch_k: int = SKETCH_K) -> None:
    """Count the contacts of one day into ``path``; only these contacts are read."""
    spark = contacts.sparkSession
    at = f"day={day.isoformat()}"
    (
        contacts.groupBy("domain").agg(
            F.count("*").alias("total"),
            F.count_if(F.col("type") == "personal").alias("personal"),
            F.count_if(F.col("type") == "role").alias("role"),
            F.count_if(F.col("mx_status") == "deliverable").alias("deliverable"),
        ).write.mode("overwrite").parquet(f"{path}/domains/{at}")
    )
    (
        spark.read.schema("domain string, total long, personal long, role long, deliverable long").parquet(f"{path}/domains/{at}")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS], F.hll_sketch_agg("domain", sketch_k).alias("sketch"))
        .write.mode("overwrite").parquet(f"{path}/totals/{at}")
    )


def _domains(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("domain string, total long, personal long, role long, deliverable long, day date").parquet(f"{path}/domains")


def kpis(spark: SparkSession, path: str, since: date | None = None, until: date | None = None, approximate: bool = False) -> DataFrame:
    """The row of ``contact_kpis`` for all added days, or those from ``since`` to ``until``; other days are not read."""
    def chosen(rows: DataFrame) -> DataFrame:
        if since:
            rows = rows.where(F.col("day") >= F.lit(since))
        return rows.where(F.col("day") <= F.lit(until)) if until else rows

    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS]
    if approximate:
        totals = spark.read.schema("total long, personal long, role long, deliverable long, sketch binary, day date").parquet(f"{path}/totals")
        out = chosen(totals).agg(*sums, F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("domains"))
    else:
        # Per domain first, so that no day's list of domains is expanded for the distinct count.
        merged = chosen(_domains(spark, path)).groupBy("domain").agg(*sums)
        out = merged.agg(*sums, F.count("domain").alias("domains"))
    return out.select("total", "personal", "role", "domains", "deliverable")


def facets(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``domain_facets`` for all added days."""
    return (
        _domains(spark, path).where(F.length("domain") > 0).groupBy("domain").agg(F.sum("total").alias("count")).orderBy("domain")
    )
