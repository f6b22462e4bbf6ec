"""Lookup joins against a dimension that has one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup(facts: DataFrame, dim: DataFrame, key: str | list[str], how: str = "left") -> DataFrame:
    """Join facts to a dimension whose keys may be very unevenly used (mail domains, hosts, files).

    A dimension within Spark's size-checked broadcast limit is broadcast.  Beyond
    it the join shuffles, and adaptive skew handling splits a hot key's facts over
    several tasks by ranges of map output, so identical rows are split as well and
    only the hot partition of the dimension is read more than once.  The session
    settings let it do so also where a later step could have used the partitioning.
    """
    return facts.join(dim, key, how)
