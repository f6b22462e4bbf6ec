"""First matching rule of a table of substrings, without comparing every text with every rule.

A rule is found by one 4-gram of its pattern, the one that the fewest texts hold, and
verified where that gram occurs; a pattern shorter than four characters is its own gram.
A common ending such as ".com" thus brings in a rule only if the rule is nothing else.
Every distinct text is judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.operators.joins import lookup

GRAM = 4


def _grams(text: Column, size: int) -> Column:
    if size == 0:
        return F.array(F.lit(""))
    spans = F.sequence(F.lit(1), F.length(text) - (size - 1))
    cut = F.transform(spans, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def first_rule(rows: DataFrame, rules: DataFrame, text: str, add: list[str], pattern: str = "pattern", ord_col: str = "ord") -> DataFrame:
    """Rows with the columns ``add`` of the first rule (by ``ord_col``, then pattern) whose pattern their text contains, else null.

    Case does not matter.  A null text or pattern matches nothing; an empty pattern matches every text.
    """
    held = rules.select(
        F.lower(F.col(pattern)).alias("__pattern"), F.struct(F.col(ord_col).alias("ord"), F.lower(F.col(pattern)).alias("p")).alias("__rank"),
        F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(add)]).alias("__add"),
    ).where("__pattern is not null")
    # Of rules with one pattern only the first can win.
    held = held.groupBy("__pattern").agg(F.min("__rank").alias("__rank"), F.min_by("__add", "__rank").alias("__add"))
    size = F.least(F.length("__pattern"), F.lit(GRAM))
    sizes = sorted(r[0] for r in held.select(size).distinct().collect())
    texts = rows.select(F.lower(F.col(text)).alias("__text")).where("__text is not null").distinct()
    grams = F.flatten(F.array(*[_grams(F.col("__text"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    placed = texts.select("__text", F.explode(grams).alias("__gram"))
    cases = F.coalesce(*[F.when(size == n, _grams(F.col("__pattern"), n)) for n in sizes]) if sizes else F.array().cast("array<string>")
    anchors = held.select("__pattern", F.explode(cases).alias("__gram"))
    frequency = placed.join(anchors.select("__gram").distinct(), "__gram", "left_semi").groupBy("__gram").agg(F.count("*").alias("__n"))
    # A gram that no text holds rules its rule out.
    rarest = anchors.join(frequency, "__gram", "left").groupBy("__pattern").agg(
        F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__gram").alias("g"))).alias("__b")
    )
    index = rarest.where("__b.n > 0").select("__pattern", F.col("__b.g").alias("__gram")).join(held, "__pattern")
    found = (
        placed.join(index, "__gram").where(F.contains("__text", "__pattern"))
        .groupBy("__text").agg(F.min_by("__add", "__rank").alias("__add"))
    )
    out = lookup(rows.withColumn("__text", F.lower(F.col(text))), found, "__text")
    return out.select(*rows.columns, *[F.col(f"__add.v{i}").alias(c) for i, c in enumerate(add)])
