"""Running values over long ordered sequences, safe for hot keys.

A plain window sends every row of a key to one task.  Here the rows are range
partitioned by (key, order), so a key with a third of all rows spans many
tasks; each range is scanned on its own, and one small row per (range, key)
carries the running value across ranges.  The ranged rows are checkpointed so
that a lost executor cannot move range borders between the two passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake.session import ensure_checkpoint_dir

_RANGE = "__range"
# Spark prunes "row_number <= n" per task before the shuffle only up to this n
# (default of spark.sql.optimizer.windowGroupLimitThreshold).
PRUNED_RANKS = 1000


def _ranges(df: DataFrame, keys: list[str], order: list[Column], ranges: int | None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    return ranged.withColumn(_RANGE, F.spark_partition_id()).checkpoint(eager=True)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    row_number: str | None = None,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add running row numbers and sums (inclusive), and maxima, per key.

    ``order`` must be unique within a key (add an id), else ties are arbitrary.
    A maximum may refer to the row number through ``F.col(row_number)``.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    base = _ranges(df, keys, order, ranges)
    part = [_RANGE, *keys]
    local = Window.partitionBy(*part).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = dict(sums)
    if row_number:
        counted[row_number] = F.lit(1).cast("long")

    # Pass 1: one row per (range, key); ranges of one key are chained in order.
    totals = base.groupBy(*part).agg(*[F.sum(c).alias(f"__t_{name}") for name, c in counted.items()] or [F.count("*").alias("__n")])
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part,
        *[F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__o_{name}") for name in counted],
    )
    out = base
    for name, c in counted.items():
        out = out.withColumn(f"__l_{name}", F.sum(c).over(upto))
    if counted:
        out = _attach(out, offsets, part)
        for name in counted:
            out = out.withColumn(name, F.col(f"__l_{name}") + F.col(f"__o_{name}"))
    if maxima:
        peaks = out.groupBy(*part).agg(*[F.max(c).alias(f"__t_{name}") for name, c in maxima.items()])
        carried = peaks.select(
            *part, *[F.max(f"__t_{name}").over(before).alias(f"__m_{name}") for name in maxima]
        )
        for name, c in maxima.items():
            out = out.withColumn(f"__x_{name}", F.max(c).over(upto))
        out = _attach(out, carried, part)
        for name in maxima:
            out = out.withColumn(name, F.greatest(F.col(f"__x_{name}"), F.col(f"__m_{name}")))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def _attach(rows: DataFrame, summary: DataFrame, part: list[str]) -> DataFrame:
    # (range, key) is never larger than one range, so this join cannot skew.
    cond = None
    for c in part:
        test = rows[c].eqNullSafe(summary[c])
        cond = test if cond is None else cond & test
    return rows.join(summary, cond).drop(*[summary[c] for c in part])


def ranked(
    df: DataFrame, keys: list[str], order: list[Column], name: str, limit: int | None, ranges: int | None = None
) -> DataFrame:
    """Rank rows per key and keep the first ``limit`` (all when None).

    Small limits are cut per task before the shuffle; beyond that, and without
    a limit, a key's rows are ranked across ranges so that none fills a task.
    """
    if limit is not None and limit <= PRUNED_RANKS:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)
    out = running(df, keys, order, row_number=name, ranges=ranges)
    out = out.withColumn(name, F.col(name).cast("int"))
    return out if limit is None else out.where(F.col(name) <= limit)
