"""Mixing sources to target weights by Pareto order sampling.

Every document gets its certain whole copies first; the fractional rest of a
source's target is filled by documents in the order of

    Q = (u / (1 - u)) / (p / (1 - p))

with u a hash of the document id in (0, 1) and p the fractional copies still
due to it (the inclusion probability).  Low Q goes first until the source's
remaining words are reached, so the sample has a fixed size in words.

Scale: a source may hold any share of the rows.  Ranks are never sorted per
source; words are summed per (source, rank bucket), the bucket that crosses the
target is found among at most ``buckets`` rows of a source, and only that
bucket's narrow rows are ordered.  What comes out is one threshold per source,
so documents are decided where they are read and texts never move.

Nulls: a null text has size 0; a null source is a source of its own, last in
order; a null id hashes as the empty string.  Rows that repeat an id and a size
share a rank and are taken together.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake.llm.common import Guarded, materialise, whole_text, words

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKETS = 4096
SEED = "mix-1"


def unit_hash(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key alone: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), key))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(per_source: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Add ``target`` to rows (source, source_size).

    Targets share the sum of all sizes by weight; one that would pass
    ``max_copies`` times its source stops there and the excess is reshared.
    Sources with the lowest size per weight stop first, so the level that the
    others share follows from running sums over that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn(
        "__w", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    ).withColumn("__cap", F.col("source_size") * max_copies)
    order = Window.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("__w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        ranked.withColumn("__i", F.row_number().over(order))
        .withColumn("__level", (F.sum("source_size").over(everything) - before) / left)
        .withColumn("__free", F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__i")))
    )
    first_free = F.min("__free").over(everything)
    shared = F.min(F.when(F.col("__i") == F.col("__first"), F.col("__level"))).over(everything)
    return (
        level.withColumn("__first", first_free)
        .withColumn("__shared", shared)
        .withColumn(
            "target",
            F.when(F.col("__i") < F.col("__first"), F.col("__cap").cast("double")).otherwise(
                F.col("__shared") * F.col("__w")
            ),
        )
        .select("source", "source_size", "__n", "__mass", "target")
    )


def _expected(max_copies: int) -> Column:
    """Documents at least as heavy as ``__full`` get all copies; the others share the words that are due by weight."""
    cap = F.lit(float(max_copies))
    share = F.when(F.col("__mass") > 0, F.col("__due") * F.col("__weight") / F.col("__mass")).otherwise(F.lit(0.0))
    return F.when(F.col("__weight") >= F.col("__full"), cap).otherwise(F.least(share, cap))


def _reshare(attached: Callable[[DataFrame], DataFrame], targets: DataFrame, max_copies: int) -> DataFrame:
    """Words that documents would take beyond ``max_copies`` copies go to the lighter documents of their source.

    Each round adds documents that reach the limit, heaviest first, until no source has a new one.
    """
    targets = targets.withColumn("__full", F.lit(None).cast("double"))
    while True:
        full = _expected(max_copies) >= max_copies
        found = attached(targets).groupBy("source").agg(
            F.min(F.when(full, F.col("__weight"))).alias("__new"),
            F.sum(F.when(full, F.col("__size")).otherwise(0)).alias("__held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("__size") * F.col("__weight"))).alias("__rest"),
        ).withColumnRenamed("source", "__source")
        joined = materialise(
            targets.join(found, targets["source"].eqNullSafe(found["__source"])).drop("__source"), "mix-reshared"
        )
        changed = joined.where(F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("__full"))).limit(1).count()
        if not changed:
            return targets
        targets = joined.select(
            "source", "source_size", "__n", F.col("__rest").alias("__mass"), "target",
            (F.col("target") - F.lit(max_copies) * F.col("__held")).alias("__due"), F.col("__new").alias("__full"),
        )


def _with_copies(rows: DataFrame, max_copies: int) -> DataFrame:
    """Expected copies, the certain ones, and the rank of the rest (0 to 1, monotone in Q)."""
    out = rows.withColumn("__e", _expected(max_copies))
    out = out.withColumn("__whole", F.floor("__e")).withColumn("__p", F.col("__e") - F.floor("__e"))
    odds = (F.col("__u") * (1 - F.col("__p"))) / ((1 - F.col("__u")) * F.col("__p"))
    return out.withColumn("__rank", F.when(F.col("__p") > 0, odds / (1 + odds)))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    buckets: int = BUCKETS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
) -> DataFrame:
    """All rows of ``docs`` plus mix_size, mix_source_size, mix_target, mix_copies, mix_taken.

    ``weight_col`` (positive) makes inclusion unequal within a source; without it, all documents of a source have
    the same probability.
    """
    held = Guarded(docs)
    weight = F.lit(1.0)
    if weight_col:
        weight = F.greatest(F.coalesce(held.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    measured = held.rows.select(
        "*", F.coalesce(held.col(id_col).cast("string"), F.lit("")).alias("__key"), held.col(source_col).alias("source"),
        F.size(words(whole_text(held.col(text_col)))).cast("long").alias("__size"), weight.alias("__weight"),
    )
    narrow = materialise(measured.select("__key", "source", "__size", "__weight"), "mix-sizes")
    narrow = narrow.withColumn("__u", unit_hash(F.col("__key"), seed))
    per_source = narrow.groupBy("source").agg(
        F.sum("__size").alias("source_size"), F.count("*").alias("__n"),
        F.sum(F.col("__size") * F.col("__weight")).alias("__mass"),
    )
    targets = materialise(source_targets(per_source, weights, max_copies), "mix-targets")

    def attach(rows: DataFrame, dim: DataFrame, mine: Column) -> DataFrame:
        dim = dim.withColumnRenamed("source", "__source")
        return rows.join(dim, mine.eqNullSafe(dim["__source"]), "left").drop("__source")

    targets = targets.withColumn("__due", F.col("target"))
    if weight_col:
        targets = _reshare(lambda t: attach(narrow, t, narrow["source"]), targets, max_copies)
    else:
        # Equal weights: a target is at most max_copies times its source, so nobody is beyond the limit.
        targets = targets.withColumn("__full", F.lit(None).cast("double"))
    ranked = _with_copies(attach(narrow, targets, narrow["source"]), max_copies)
    ranked = ranked.withColumn("__bucket", F.floor(F.col("__rank") * buckets).cast("int"))
    # One row per source and bucket; certain copies fall into the null bucket or their own alike.
    sums = ranked.groupBy("source", "__bucket").agg(
        F.sum("__size").alias("__words"),
        F.sum(F.col("__size") * F.col("__whole")).alias("__certain"),
        F.min("target").alias("target"),
    )
    over = Window.partitionBy("source")
    upto = over.orderBy(F.col("__bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("__need", F.col("target") - F.sum("__certain").over(over)).withColumn(
        "__upto", F.sum(F.when(F.col("__bucket").isNotNull(), F.col("__words")).otherwise(0)).over(upto)
    )
    crossing = (
        sums.where(F.col("__bucket").isNotNull() & (F.col("__upto") >= F.col("__need")) & (F.col("__need") > 0))
        .groupBy("source")
        .agg(F.min(F.struct("__bucket", (F.col("__upto") - F.col("__words")).alias("__before"), "__need")).alias("__b"))
        .select("source", "__b.*")
    )
    needs = sums.groupBy("source").agg(F.min("__need").alias("__need_all"))
    edge = crossing.select(
        F.col("source").alias("__source"), F.col("__bucket").alias("__cross"), "__before", "__need"
    )
    rank = F.struct("__rank", "__key", "__size")
    row = over.orderBy("__rank", "__key", "__size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy("source", "__rank", "__key", "__size")
    inside = (
        ranked.join(edge, ranked["source"].eqNullSafe(edge["__source"]) & (ranked["__bucket"] == edge["__cross"]))
        .select("source", "__rank", "__key", "__size", "__before", "__need")
        .withColumn("__tied", F.sum("__size").over(ties))
        .withColumn("__start", F.col("__before") + F.sum("__size").over(row) - F.col("__tied"))
        # The document on the edge goes in if that brings the source nearer to its target.
        .where((F.col("__start") < F.col("__need")) & (F.col("__tied") <= 2 * (F.col("__need") - F.col("__start"))))
        .groupBy("source")
        .agg(F.max(rank).alias("__last"))
    )
    inside = inside.select(F.col("source").alias("__in"), "__last")
    cuts = (
        needs.join(edge, needs["source"].eqNullSafe(edge["__source"]), "left").drop("__source")
        .join(inside, needs["source"].eqNullSafe(inside["__in"]), "left").drop("__in")
        .select("source", "__need_all", "__cross", "__last")
    )
    plan = attach(targets, cuts, targets["source"]).select(
        F.col("source").alias("__msource"), F.col("source_size").alias("mix_source_size"), "__mass", "__due", "__full",
        F.col("target").alias("target"), "__need_all", "__cross", "__last",
    )
    plan = materialise(plan, "mix-plan")

    out = measured.withColumn("__u", unit_hash(F.col("__key"), seed))
    out = _with_copies(out.join(plan, out["source"].eqNullSafe(plan["__msource"]), "left"), max_copies)
    bucket = F.floor(F.col("__rank") * buckets).cast("int")
    picked = (
        F.col("__rank").isNotNull() & (F.col("__need_all") > 0)
        & (F.col("__cross").isNull() | (bucket < F.col("__cross"))
           | ((bucket == F.col("__cross")) & F.coalesce(rank <= F.col("__last"), F.lit(False))))
    )
    out = out.withColumn("__copies", (F.col("__whole") + F.when(picked, 1).otherwise(0)).cast("int"))
    return held.restore(out, {
        "mix_size": F.col("__size"), "mix_source_size": F.col("mix_source_size"), "mix_target": F.col("target"),
        "mix_copies": F.col("__copies"), "mix_taken": F.col("__size") * F.col("__copies"),
    })


def copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per copy that the mix takes."""
    return mixed.where(F.col("mix_copies") > 0).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    ).select(*columns)
