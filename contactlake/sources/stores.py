"""Persisted JSON stores: suppression entries, folders, jobs, export audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlake.operators.joins import lookup
from contactlake.sources.json_splits import Levels, json_elements

SUPPRESSION = "id string, type string, value string, reason string, addedByUserId string, createdAt string, note string"
RECORD = (
    "email string, domain string, type string, name string, company string, jobTitle string, phone string, "
    "mxStatus string, provider string, isCatchAll boolean, sourceUrl string, pageTitle string, "
    "contextSnippet string, discoveredAt string, socials struct<linkedin:string,twitter:string,github:string>"
)
_RECORD_FIELDS = RECORD.replace(" string", ":string").replace(" boolean", ":boolean").replace(" struct", ":struct")
FOLDER = "id string, name string, createdAt string, updatedAt string"
FOLDERS = f"{FOLDER}, records array<struct<{_RECORD_FIELDS}>>"
JOBS = (
    "id string, url string, status string, ownerId string, params map<string,string>, pagesVisited int, pagesSkipped int, "
    "pagesFailed int, errors int, startedAt bigint, endedAt bigint, durationMs bigint, cancelled boolean, retryCount int, "
    "maxRetries int, errorMessage string, accessRestrictedReason string, isBrowser boolean, expiresAt bigint, updatedAt bigint"
)
AUDIT = (
    "id string, userId string, userRole string, timestamp string, format string, recordCount bigint, clientIp string, "
    "exportedFields array<string>, exportSegment string, filename string, filterSuppressed boolean"
)


def _snake(name: str) -> str:
    return "".join("_" + ch.lower() if ch.isupper() else ch for ch in name)


# Entries are documents of their own or elements of an array; records lie one level below their folder.
ENTRY_LEVELS = Levels(array=(0, 1), object=(0, 0))
RECORD_LEVELS = Levels(array=(1, 3), object=(0, 2))


def _parsed(rows: DataFrame, schema: str) -> Column:
    """The text as a struct; null where it is no such JSON."""
    record = F.from_json("text", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return F.when(record["_broken"].isNull(), record)


def _read(spark: SparkSession, path: str, schema: str, key: str, multi_line: bool) -> DataFrame:
    """JSON arrays or objects; unreadable documents are skipped.

    Stores come as JSON lines, which split at line ends; with ``multi_line`` a file may be one array or any
    sequence of documents, and is split anywhere.
    """
    if not multi_line:
        raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
        return raw.where(F.col(key).isNotNull())
    elements, _ = json_elements(spark, path, ENTRY_LEVELS)
    rows = elements.select(_parsed(elements, schema).alias("r")).select("r.*").drop("_broken")
    return rows.where(F.col(key).isNotNull())


def read_suppression(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    rows = _read(spark, path, SUPPRESSION, "id", multi_line)
    return rows.select(
        "id", "type", "value", "reason", F.col("addedByUserId").alias("added_by"),
        F.try_to_timestamp("createdAt").alias("created_at"), "note",
    )


def read_folders(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(folders, records): the record lists become rows with their position.

    With ``multi_line`` records are read one by one, so that a folder may hold any number of them.
    """
    if multi_line:
        elements, documents = json_elements(spark, path, RECORD_LEVELS)
        rows = documents.select("file", "document", _parsed(documents, FOLDER).alias("r"), F.json_object_keys("text").alias("keys"))
        rows = rows.where("r.id is not null").select("file", "document", "r.*", (F.array_position("keys", "records") - 1).alias("list"))
        held = lookup(elements.where("container = '['"), rows.select("file", "document", F.col("id").alias("folder_id"), "list"), ["file", "document"], "inner")
        held = held.where(F.col("member") == F.col("list"))
        exploded = held.select("folder_id", F.col("ord").cast("int").alias("pos"), _parsed(held, RECORD).alias("r")).where("r is not null")
    else:
        rows = _read(spark, path, FOLDERS, "id", False)
        exploded = rows.select(F.col("id").alias("folder_id"), F.posexplode("records").alias("pos", "r"))
    folders = rows.select(
        F.col("id").alias("folder_id"), "name",
        F.try_to_timestamp("createdAt").alias("created_at"), F.try_to_timestamp("updatedAt").alias("updated_at"),
    )
    fields = exploded.schema["r"].dataType
    assert isinstance(fields, T.StructType)
    names = [f.name for f in fields.fields if f.name != "_broken"]
    records = exploded.select("folder_id", "pos", *[F.col(f"r.{n}").alias(_snake(n)) for n in names])
    return folders, records


def read_jobs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One file per job, or an array of jobs; epoch milliseconds become timestamps."""
    rows = _read(spark, path, JOBS, "id", multi_line)
    times = {"startedAt", "endedAt", "expiresAt", "updatedAt"}
    names = {"id": "job_id", "ownerId": "owner"}
    return rows.select(
        *[
            (F.timestamp_millis(F.col(c)) if c in times else F.col(c)).alias(names.get(c, _snake(c)))
            for c in rows.columns
        ]
    )


def read_audit(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    rows = _read(spark, path, AUDIT, "id", multi_line)
    return rows.select(
        *[
            (F.try_to_timestamp(F.col(c)) if c == "timestamp" else F.col(c)).alias(_snake(c))
            for c in rows.columns
        ]
    )
