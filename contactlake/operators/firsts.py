"""First-wins and last-wins selection without per-key windows.

``min_by`` / ``max_by`` aggregate partially before the shuffle, so a key that
holds a third of all rows shrinks to one row per map task.  A window would send
all of its rows to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """One whole row per key: the smallest by ``order``."""
    return _pick(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """One whole row per key: the largest by ``order``."""
    return _pick(df, keys, order, F.max_by)


def _pick(df: DataFrame, keys, order, chooser) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.struct(*order) if len(order) > 1 else (order[0] if isinstance(order[0], Column) else F.col(order[0]))
    key_cols = [(k if isinstance(k, Column) else F.col(k)).alias(f"__k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*key_cols).agg(chooser(row, rank).alias("__row")).select("__row.*")
