"""Substring search through a stored index of character runs (A10 on a stored dataset).

Contacts are stored in blocks of neighbouring rows (ordered by domain and address), and for
every block and searched field the runs of one, two and three characters that its texts hold.
A search reads the lists of its own runs, keeps the blocks where one field holds them all, and
scans only these with the plain test, so its rows are those of ``search_contacts`` on all rows.

Scale: a list names blocks, not rows, so the list of a run that every row holds is no longer than
the number of blocks.  Blocks are range partitions of about ``block_rows`` rows, a folder each;
found blocks prune folders at run time where their list fits a broadcast, else they are joined.

Every addition has a name and its own folders; the lists are written after the rows, and an
addition whose lists are not complete is never read.  One that was cut off is repeated under its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.operators.datasets import SEARCH_FIELDS, search_contacts
from contactlake.operators.stored import Folder

BLOCK_ROWS = 65_536
BUCKETS = 64
RUN = 3
FIELDS = sorted({field for fields in SEARCH_FIELDS.values() for field in fields})


def _runs(text: Column) -> Column:
    """Distinct runs of one to ``RUN`` characters, by one pass of a pattern per length; no run starts inside a character."""
    return F.array_distinct(
        F.concat(*[F.regexp_extract_all(text, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, RUN + 1)])
    )


def _bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


def indexed(spark: SparkSession, path: str, name: str) -> bool:
    """Whether an addition of this name is complete."""
    return Folder(spark, path).exists(f"lists/added={name}/_SUCCESS")


def additions(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete additions, from the listing of the folder."""
    names = [n.removeprefix("added=") for n in Folder(spark, f"{path}/rows").names() if n.startswith("added=")]
    return sorted(n for n in names if indexed(spark, path, n))


def add_to_index(contacts: DataFrame, path: str, name: str, block_rows: int = BLOCK_ROWS) -> bool:
    """Add contacts under a name of letters, digits, ``-`` and ``_``; False if that addition is complete already.

    Fields that are missing or null are not found by them.  Empty additions are allowed.
    """
    if not name or not name.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"not a name for an addition: {name!r}")
    spark = contacts.sparkSession
    if indexed(spark, path, name):
        return False
    total = contacts.count()
    by = [F.col(c) for c in ("domain", "email") if c in contacts.columns]
    # Rows that repeat an address share no more than their place in the order: a hash of the row tells them apart.
    every = F.xxhash64(*[F.col(f"`{c}`") for c in contacts.columns])
    (
        contacts.repartitionByRange(max(1, -(-total // block_rows)), *by, every)
        .withColumn("block", F.spark_partition_id())
        .write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows/added={name}")
    )
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in contacts.schema.fields)}, block int"
    rows = spark.read.schema(schema).parquet(f"{path}/rows/added={name}")
    texts = [F.struct(F.lit(f).alias("field"), F.lower(F.col(f)).alias("text")) for f in FIELDS if f in contacts.columns]
    texts = rows.select("block", F.explode(F.array(*texts)).alias("t")).select("block", "t.*")
    # Outer, as Spark would else take every text apart a second time to filter on the number of its runs.
    held = texts.select("block", "field", F.explode_outer(_runs(F.col("text"))).alias("run")).where("run is not null").distinct()
    (
        held.withColumn("bucket", _bucket(F.col("run"))).repartition("bucket").sortWithinPartitions("bucket", "run", "field")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists/added={name}")
    )
    return True


def candidate_blocks(spark: SparkSession, path: str, query: str, fields: str = "session") -> DataFrame:
    """(added, block) of the blocks where one field of the set holds every run of the query."""
    text = query.lower()
    n = min(RUN, len(text))
    runs = sorted({text[i : i + n] for i in range(len(text) - n + 1)})
    lists = spark.read.schema("block int, field string, run string, added string, bucket int").parquet(f"{path}/lists")
    return (
        lists.where(F.col("added").isin(additions(spark, path)))
        .where(F.col("bucket").isin([_bucket(F.lit(r)) for r in runs]) & F.col("run").isin(runs))
        .where(F.col("field").isin(list(SEARCH_FIELDS[fields])))
        .groupBy("added", "block", "field").agg(F.count("*").alias("n")).where(F.col("n") == len(runs))
        .select("added", "block").distinct()
    )


def search_index(spark: SparkSession, path: str, query: str | None = None, fields: str = "session", **filters) -> DataFrame:
    """The rows of ``search_contacts`` on everything that is indexed, plus ``added`` and ``block``; a blank query reads all blocks."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    rows = rows.withColumn("added", F.col("added").cast("string")).where(F.col("added").isin(additions(spark, path)))
    if query and query.strip():
        rows = rows.join(candidate_blocks(spark, path, query, fields), ["added", "block"], "left_semi")
    return search_contacts(rows, query, fields, **filters)
