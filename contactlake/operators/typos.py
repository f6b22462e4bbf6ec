"""Likely intended domains out of a table of any size, by deletion neighbourhoods.

Two names within two edits have a common form with at most two characters deleted from
each.  Targets and distinct domains are expanded to the hashes of such forms and joined by
equality; the pairs that meet are verified by their edit distance.  Domains longer than any
target can reach are not expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions.text import let, strip_ws
from contactlake.operators.joins import lookup


def _shorter(text: Column) -> Column:
    """The text without each of its characters."""
    spans = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(spans, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def _forms(text: Column) -> Column:
    """Hashes of the text with none, one or two characters deleted."""

    def expand(one: Column) -> Column:
        return F.array_distinct(F.transform(F.concat(F.array(text), one, F.flatten(F.transform(one, _shorter))), lambda x: F.xxhash64(x)))

    return let(F.array_distinct(_shorter(text)), expand)


def nearest_target(
    rows: DataFrame, targets: DataFrame, domain: str = "domain", target: str = "target", ord_col: str = "ord", out: str = "typo_target"
) -> DataFrame:
    """Rows with the first target (by ``ord_col``, then name) that their domain misspells, else null.

    A domain misspells a target at one edit, or at two where the lengths differ by one at most.  A domain that
    is a target itself is right.  Case and surrounding blanks do not matter; nulls match nothing.
    """
    name = lambda c: strip_ws(F.lower(F.col(c)))
    held = targets.select(name(target).alias("__t"), F.col(ord_col).alias("__o")).where("__t is not null")
    held = held.groupBy("__t").agg(F.min("__o").alias("__o"))
    longest = held.agg(F.coalesce(F.max(F.length("__t")), F.lit(-2)).alias("n")).first().n
    wanted = rows.select(name(domain).alias("__d")).where("__d is not null").distinct()
    wanted = wanted.where(F.length("__d") <= longest + 1).join(held, F.col("__d") == F.col("__t"), "left_anti")
    # Names are few bytes and much work: a fixed number of tasks expands them, where sizes alone would leave them to one.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted, spread = wanted.repartition(parts, F.xxhash64("__d")), held.repartition(parts, F.xxhash64("__t"))
    forms = wanted.select("__d", F.explode(_forms(F.col("__d"))).alias("__form"))
    index = spread.select("__t", "__o", F.explode(_forms(F.col("__t"))).alias("__form"))
    near = F.abs(F.length("__d") - F.length("__t")) <= 1
    # Forms are many times the names that Spark measures them by: neither side is broadcast.
    pairs = forms.join(index.hint("merge"), "__form").where(near & (F.levenshtein("__d", "__t", 2) > 0))
    found = pairs.groupBy("__d").agg(F.min(F.struct("__o", "__t"))["__t"].alias(out))
    return lookup(rows.drop(out).withColumn("__d", name(domain)), found, "__d").drop("__d")
