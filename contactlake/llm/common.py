"""Shared pieces: word splitting, written intermediate tables, input columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.session import shared_dir

BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole_text(c: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def words(text: Column) -> Column:
    """Runs of anything but ASCII blanks, in order."""
    return F.array_remove(F.split(text, BLANKS), "")


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(c, UPPER, UPPER.lower())


def ascii_strip(c: Column) -> Column:
    """Without the ASCII blanks at both ends."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def shared_path(spark, label: str) -> str:
    """A new folder name under the cluster's checkpoint folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back, so that nothing above runs twice."""
    path = shared_path(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Guarded:
    """Input rows under names that cannot clash with an operator's own columns.

    ``rows`` has the input columns renamed by position; ``restore`` brings the
    names back and appends the operator's columns, which replace input columns
    of the same name.
    """

    def __init__(self, df: DataFrame):
        self.names = list(df.columns)
        self.rows = df.toDF(*[f"__in{i}" for i in range(len(self.names))])

    def col(self, name: str) -> Column:
        return F.col(f"__in{self.names.index(name)}")

    def name(self, name: str) -> str:
        return f"__in{self.names.index(name)}"

    def restore(self, df: DataFrame, added: dict[str, Column] | None = None, replaced: dict[str, Column] | None = None) -> DataFrame:
        added, replaced = added or {}, replaced or {}
        kept = [
            (replaced[n] if n in replaced else F.col(f"__in{i}")).alias(n)
            for i, n in enumerate(self.names) if n not in added
        ]
        return df.select(*kept, *[c.alias(n) for n, c in added.items()])
