"""Exports: CSV, JSON, plain list, vCard, and the audited export job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlake import constants as K
from contactlake.functions import addresses as A
from contactlake.functions.redact import csv_guard
from contactlake.operators import datasets, privacy, suppression
from contactlake.session import ensure_checkpoint_dir

BOM = "\ufeff"


def _chosen(fields) -> list[str]:
    return list(fields) if fields else list(K.DEFAULT_EXPORT_FIELDS)


def _as_text(df: DataFrame, key: str) -> Column:
    """Export text of a field: strings as they are, other values as JSON, nothing for falsy."""
    if key == "isCatchAll":
        return F.when(F.coalesce("is_catch_all", F.lit(False)), "Yes (Accept-All Gateway)").otherwise("No")
    col, _ = datasets.export_field(key)
    dtype = df.select(col.alias("x")).schema["x"].dataType
    if isinstance(dtype, T.StringType):
        return F.coalesce(col, F.lit(""))
    if isinstance(dtype, T.TimestampType):
        return F.coalesce(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "true").otherwise("")
    if isinstance(dtype, T.NumericType):
        return F.when(col != 0, col.cast("string")).otherwise("")
    return F.coalesce(F.to_json(col), F.lit(""))


def _csv_cell(text: Column) -> Column:
    flat = F.regexp_replace(F.replace(text, F.lit('"'), F.lit('""')), r"[\r\n]+", " ")
    return F.concat(F.lit('"'), csv_guard(flat), F.lit('"'))


def csv_header(fields: list[str] | None = None) -> str:
    return ",".join(f'"{datasets.export_field(k)[1]}"' for k in _chosen(fields))


def csv_lines(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One finished CSV line per contact (column ``value``)."""
    return df.select(F.concat_ws(",", *[_csv_cell(_as_text(df, k)) for k in _chosen(fields)]).alias("value"))


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Spreadsheet-ready CSV: BOM and one header per export, CRLF between lines.

    The header is the first part file, also of an empty export; the parts joined
    in order of their names are the whole file.
    """
    head = df.sparkSession.range(1).coalesce(1).select(F.lit(BOM + csv_header(fields)).alias("value"))
    head.unionByName(csv_lines(df, fields)).write.mode(mode).option("lineSep", "\r\n").text(path)


def json_rows(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Selected keys; missing values become empty strings."""
    out = []
    for key in _chosen(fields):
        col, _ = datasets.export_field(key)
        dtype = df.select(col.alias("x")).schema["x"].dataType
        if isinstance(dtype, T.StringType):
            col = F.coalesce(col, F.lit(""))
        elif isinstance(dtype, T.TimestampType):
            col = _as_text(df, key)
        out.append(col.alias(key))
    return df.select(*out)


def json_lines(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One JSON object per contact (column ``value``)."""
    rows = json_rows(df, fields)
    present = F.to_json(F.struct(*rows.columns))
    # Null non-strings are written as "" like every other missing value.
    typed = [f.name for f in rows.schema.fields if not isinstance(f.dataType, T.StringType)]
    value = present
    for name in typed:
        value = F.when(
            F.col(f"`{name}`").isNull(),
            F.concat(F.regexp_replace(value, r"\}$", ""), F.when(value == "{}", "").otherwise(","), F.lit(f'"{name}":""}}')),
        ).otherwise(value)
    return rows.select(value.alias("value"))


def write_json(
    df: DataFrame, path: str, fields: list[str] | None = None, mode: str = "errorifexists", array: bool = False
) -> None:
    """JSON lines; with ``array`` the parts joined in order of their names are one JSON array."""
    lines = json_lines(df, fields)
    if array:
        # Rows keep their places once written down; all but the first begin with a comma.
        ensure_checkpoint_dir(df.sparkSession)
        placed = lines.withColumn("id", F.monotonically_increasing_id()).checkpoint()
        first = placed.agg(F.min("id")).first()[0]
        comma = F.when(F.col("id") == F.lit(first), "").otherwise(",")
        edge = lambda text: df.sparkSession.range(1).coalesce(1).select(F.lit(text).alias("value"))
        lines = edge("[").unionByName(placed.select(F.concat(comma, "value").alias("value"))).unionByName(edge("]"))
    lines.write.mode(mode).text(path)


def txt_lines(df: DataFrame) -> DataFrame:
    """Distinct lower-case addresses in order."""
    return df.select(A.normalise(F.col("email")).alias("value")).distinct().orderBy("value")


def write_txt(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    txt_lines(df).write.mode(mode).text(path)


def _line(prefix: str, value: Column, wanted: bool = True) -> Column:
    if not wanted:
        return F.lit(None).cast("string")
    return F.when(F.length(value) > 0, F.concat(F.lit(prefix), value))


def vcards(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One vCard 3.0 block per contact (column ``value``)."""
    on = set(_chosen(fields))
    c = F.col
    name = F.coalesce(F.when(F.length("name") > 0, c("name")), A.display_name(c("email")))
    note = F.concat_ws(
        " | ",
        _line("Title: ", c("job_title")),
        _line("Discovered on: ", c("page_title"), "pageTitle" in on),
        _line("Source: ", c("source_url"), "sourceUrl" in on),
        _line("Snippet: ", c("context_snippet"), "contextSnippet" in on),
    )
    lines = [
        F.lit("BEGIN:VCARD"),
        F.lit("VERSION:3.0"),
        F.concat(F.lit("FN:"), name),
        F.concat(F.lit("N:;"), name, F.lit(";;;")),
        _line("TITLE:", c("job_title"), "jobTitle" in on),
        F.concat(F.lit("EMAIL;TYPE=INTERNET,WORK:"), c("email")),
        _line("TEL;TYPE=WORK,VOICE:", c("phone"), "phone" in on),
        F.concat(F.lit("ORG:"), F.upper("domain")) if "domain" in on else F.lit(None).cast("string"),
        _line("URL:", c("source_url"), "sourceUrl" in on),
        _line("X-SOCIALPROFILE;TYPE=linkedin:", c("socials.linkedin"), "linkedin" in on),
        _line("NOTE:", F.regexp_replace(note, r"[\r\n]+", " ")),
        F.lit("END:VCARD"),
    ]
    return df.select(F.concat_ws("\r\n", *lines).alias("value"))


def write_vcard(df: DataFrame, path: str, fields: list[str] | None = None, mode: str = "errorifexists") -> None:
    vcards(df, fields).write.mode(mode).option("lineSep", "\r\n\r\n").text(path)


WRITERS = {
    "csv": lambda df, path, fields, mode: write_csv(df, path, fields, mode),
    "json": lambda df, path, fields, mode: write_json(df, path, fields, mode),
    "txt": lambda df, path, fields, mode: write_txt(df, path, mode),
    "vcf": lambda df, path, fields, mode: write_vcard(df, path, fields, mode),
}


def export_selection(
    contacts: DataFrame, segment: str = "all", suppressed: DataFrame | None = None
) -> DataFrame:
    """Rows an export would write: suppression filter, then segment."""
    rows = contacts if suppressed is None else suppression.filter_suppressed(contacts, suppressed)
    return datasets.segment(rows, segment)


def export_contacts(
    contacts: DataFrame,
    path: str,
    format: str = "csv",
    segment: str = "all",
    fields: list[str] | None = None,
    suppressed: DataFrame | None = None,
    audit_path: str | None = None,
    user: str = "anonymous",
    role: str = "user",
    client_ip: str = "unknown",
    mode: str = "errorifexists",
) -> DataFrame:
    """Filter, segment, project, write, and log the export; returns the audit row."""
    if format not in WRITERS:
        raise ValueError(f"unknown format: {format}")
    # Counted while written, so the selection runs once.
    seen = Observation()
    rows = export_selection(contacts, segment, suppressed).observe(seen, F.count(F.lit(1)).alias("n"))
    WRITERS[format](rows, path, fields, mode)
    prefix, _ = datasets.segment_meta(segment)
    name = path.rstrip("/").rsplit("/", 1)[-1] or f"{prefix}.{format}"
    spark = contacts.sparkSession
    audit = spark.range(1).select(
        F.concat(F.lit("exp_"), F.expr("uuid()")).alias("id"),
        F.lit(user).alias("user_id"), F.lit(role).alias("user_role"), F.current_timestamp().alias("timestamp"),
        F.lit(format).alias("format"), F.lit(seen.get["n"]).cast("bigint").alias("record_count"), F.lit(client_ip).alias("client_ip"),
        F.array(*[F.lit(f) for f in fields]).alias("exported_fields") if fields else F.lit(None).cast("array<string>").alias("exported_fields"),
        F.lit(segment).alias("export_segment"), F.lit(name).alias("filename"),
        F.lit(suppressed is not None).alias("filter_suppressed"),
    )
    if audit_path:
        privacy.export_audit_append(audit, audit_path)
        return spark.read.parquet(audit_path)
    return audit
