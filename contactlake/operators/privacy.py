"""Redaction jobs, retention, account purge and the export audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlake.functions import redact as R

TERMINAL = ("completed", "cancelled", "failed")


def redact_snippets(
    df: DataFrame, col: str = "context_snippet", max_chars: int | None = 150, strip: bool = False,
    redact: bool = True, out: str | None = None,
) -> DataFrame:
    value = F.lit(None).cast("string") if strip else R.clean_snippet(F.col(col), max_chars, redact)
    return df.withColumn(out or col, value)


def redact_logs(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, R.redact_log(F.col(col)))


def mask_emails(df: DataFrame, col: str = "email", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, R.mask_email(F.col(col)))


# fixed values: field names whose content never reaches a log
_SECRET_NAMES = ("key", "token", "secret", "password", "authorization", "cookie")
_COLLECTIONS = ("emails", "records", "contacts")
_MAX_ITEMS = 5


def _is_secret(name: str) -> bool:
    return any(word in name.lower() for word in _SECRET_NAMES)


def _array(value: Column, dtype: T.ArrayType) -> Column:
    # A log line shows a short array in full and a long one as its size only.
    n = F.size(value).cast("string")
    shown = F.to_json(F.transform(value, lambda x: _clean("", x, dtype.elementType)))
    return F.when(
        F.size(value) > _MAX_ITEMS, F.concat(F.lit("[Array of "), n, F.lit(" items (summarized for privacy)]"))
    ).otherwise(shown)


def _clean(name: str, value: Column, dtype: T.DataType) -> Column:
    low = name.lower()
    if name and _is_secret(name):
        return F.lit("[REDACTED]")
    if low == "email":
        return R.mask_email(value) if isinstance(dtype, T.StringType) else F.lit("[REDACTED]")
    if low in _COLLECTIONS and isinstance(dtype, T.ArrayType):
        return F.concat(F.lit("[Collection of "), F.size(value).cast("string"), F.lit(" records]"))
    if isinstance(dtype, T.StringType):
        return R.redact_log(value)
    if isinstance(dtype, T.ArrayType):
        return _array(value, dtype)
    if isinstance(dtype, T.StructType):
        fields = [_clean(f.name, value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType) and isinstance(dtype.valueType, T.StringType):
        secret = "(?i)" + "|".join(_SECRET_NAMES)
        return F.transform_values(
            value,
            lambda k, v: F.when(k.rlike(secret), "[REDACTED]")
            .when(F.lower(k) == "email", R.mask_email(v))
            .otherwise(R.redact_log(v)),
        )
    return value


def redact_struct_logs(df: DataFrame) -> DataFrame:
    """Redact every column by field name and type, to any depth of structs."""
    return df.select(*[_clean(f.name, F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def expired_jobs(jobs: DataFrame, now: Column, retention_hours: int = 24) -> DataFrame:
    """Finished jobs whose end (or start) lies further back than the retention."""
    age_ms = F.unix_millis(now) - F.unix_millis(F.coalesce("ended_at", "started_at"))
    return jobs.where(is_terminal(F.col("status")) & (age_ms > retention_hours * 3_600_000))


def prune_expired(jobs: DataFrame, now: Column, retention_hours: int = 24) -> DataFrame:
    """Jobs that stay."""
    age_ms = F.unix_millis(now) - F.unix_millis(F.coalesce("ended_at", "started_at"))
    old = is_terminal(F.col("status")) & (age_ms > retention_hours * 3_600_000)
    return jobs.where(~F.coalesce(old, F.lit(False)))


def purge_owner(jobs: DataFrame, folders: DataFrame, records: DataFrame, owner: str) -> dict[str, DataFrame]:
    """What stays once an owner's jobs and non-default folders are gone, plus counts."""
    mine = (F.col("owner_id") == owner) & (F.col("folder_id") != "default")
    gone = folders.where(mine).select("folder_id")
    lost = records.join(gone, "folder_id", "left_semi")
    kinds = {
        "deleted_jobs": jobs.where(F.col("owner") == owner), "deleted_records": lost, "deleted_folders": gone,
    }
    tagged = None
    for kind, rows in kinds.items():
        part = rows.select(F.lit(kind).alias("kind"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds])
    return {
        "jobs": jobs.where(~F.coalesce(F.col("owner") == owner, F.lit(False))),
        "folders": folders.where(~F.coalesce(mine, F.lit(False))),
        "records": records.join(gone, "folder_id", "left_anti"),
        "counts": counts,
    }


AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("user_role", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("format", T.StringType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("exported_fields", T.ArrayType(T.StringType())),
        T.StructField("export_segment", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("filter_suppressed", T.BooleanType()),
    ]
)


def export_audit_append(audit_rows: DataFrame, path: str) -> None:
    """Append export events to the audit dataset."""
    rows = audit_rows.withColumn("user_id", F.coalesce("user_id", F.lit("anonymous"))).withColumn(
        "user_role", F.coalesce("user_role", F.lit("unknown"))
    )
    rows.select(*[f.name for f in AUDIT_SCHEMA.fields]).write.mode("append").parquet(path)


def audit_report(audit: DataFrame, user: str | None = None, is_admin: bool = False, limit: int | None = None) -> DataFrame:
    """Export events of the user (all for admins), newest first; the first ``limit`` if given."""
    trail = audit if is_admin or not user else audit.where(F.col("user_id") == user)
    trail = trail.orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return trail if limit is None else trail.limit(limit)
