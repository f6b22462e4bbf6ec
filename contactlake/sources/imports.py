"""Contact list imports: delimited text, plain text, JSON.

A list is a table of lines ``(file, line, value)``.  Lines are read in splits
like any text, numbered per file from split summaries, and parsed by column
expressions; a file of any size is never held by one task.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.functions import addresses as A
from contactlake.functions.text import blank_to_null, strip_ws
from contactlake.operators.firsts import first_per_key
from contactlake.operators.joins import lookup
from contactlake.session import ensure_checkpoint_dir
from contactlake.sources.json_splits import Levels, json_elements

# fixed values: header names per field (compared without punctuation)
HEADERS = {
    "email": ("email", "mail", "emailaddress", "contactemail"),
    "name": ("name", "fullname", "contactname", "person"),
    "title": ("title", "jobtitle", "position", "role"),
    "company": ("company", "organization", "companyname", "account"),
    "phone": ("phone", "tel", "telephone", "mobile"),
    "linkedin": ("linkedin", "linkedinurl", "social"),
}
# fixed values: JSON field names per field
JSON_KEYS = {
    "email": ("email", "mail", "emailAddress", "address"),
    "name": ("name", "fullName"),
    "title": ("jobTitle", "title", "role", "position"),
    "company": ("company", "organization"),
    "phone": ("phone", "tel", "mobile"),
}
LIST_KEYS = ("emails", "records", "contacts")
# A list is an array, or an object with one.
LIST_LEVELS = Levels(array=(0, 1), object=(0, 2))
NAMED_ADDRESS = r"""^([^<"]+?)\s*<([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})>"""
MAX_ERRORS = 10
SHOWN_CHARS = 60
# Layouts (about 200 bytes each) of so many files are broadcast; more are joined as Spark decides.
BROADCAST_FILES = 100_000


@dataclass
class ImportResult:
    """Accepted contacts (one per address), rejected lines; the summary has one row per file and is made when asked for."""

    accepted: DataFrame
    rejected: DataFrame
    normalised: DataFrame

    @cached_property
    def summary(self) -> DataFrame:
        return import_summary(self.normalised)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): trimmed, non-blank lines numbered from 1 within their file."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        strip_ws(F.col("value")).alias("value"),
    )
    # Rows of one split are contiguous and in order, so ids count lines within it.
    rows = raw.where(F.length("value") > 0).withColumn("id", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "block").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "block", "first_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(offsets, ["file", "block"]).select(
        "file", (F.col("id") - F.col("first_id") + F.col("before") + 1).alias("line"), "value"
    )


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def delimiter_of(line: Column) -> Column:
    comma, tab, semi = _count(line, ","), _count(line, "\t"), _count(line, ";")
    return F.when((tab > comma) & (tab > semi), "\t").when((semi > comma) & (semi > tab), ";").otherwise(",")


def _cells_by(line: Column, d: str) -> Column:
    # A cell is plain text and quoted sections in any mix; "" inside a section is one quote.
    # Possessive groups loop instead of recursing, so lines of any length are safe.
    quoted = r'"[^"]*+(?:""[^"]*+)*+(?:"|$)'
    cell = rf'{d}([^"{d}]*+(?:{quoted}[^"{d}]*+)*+)'
    raw = F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(cell), F.lit(1))
    return F.transform(
        raw,
        lambda c: F.trim(
            F.replace(F.regexp_replace(c, r'"([^"]*+(?:""[^"]*+)*+)(?:"|$)', "$1"), F.lit('""'), F.lit('"'))
        ),
    )


def cells(line: Column, delimiter: Column) -> Column:
    return (
        F.when(delimiter == "\t", _cells_by(line, "\t"))
        .when(delimiter == ";", _cells_by(line, ";"))
        .otherwise(_cells_by(line, ","))
    )


def list_layout(lines: DataFrame, tlds: Iterable[str] | None = None) -> DataFrame:
    """Per file: delimiter, has_header and the column of each field, from the first two lines."""
    top = lines.where(F.col("line") <= 2).groupBy("file").agg(
        F.min_by("value", "line").alias("l1"), F.max(F.when(F.col("line") == 2, F.col("value"))).alias("l2")
    )
    top = top.withColumn("delimiter", delimiter_of(F.col("l1")))
    top = top.withColumn("c1", cells(F.col("l1"), F.col("delimiter"))).withColumn(
        "c2", F.coalesce(cells(F.col("l2"), F.col("delimiter")), F.array().cast("array<string>"))
    )
    names = F.transform("c1", lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))
    top = top.withColumn("names", names)

    def last_column(field: str) -> Column:
        # The last matching column wins; -1 when absent.
        at = F.transform("names", lambda n, i: F.when(n.isin(*HEADERS[field]), i).otherwise(-1))
        return F.array_max(at)

    found = top.select("*", *[last_column(f).alias(f"col_{f}") for f in HEADERS])
    many = F.size("c1") > 1
    has_header = (F.col("col_email") >= 0) | (many & ~F.contains("l1", F.lit("@")))
    sampled = F.array_min(
        F.filter(
            F.transform("c2", lambda c, i: F.when(c.contains("@") & A.has_valid_tld(c, tlds), i)),
            lambda i: i.isNotNull(),
        )
    )
    email_at = F.when(F.col("col_email") >= 0, F.col("col_email")).when(has_header, sampled)
    return found.select(
        "file", "delimiter", has_header.alias("has_header"),
        F.when(many | has_header, "csv").otherwise("plaintext").alias("format"),
        F.coalesce(email_at, F.lit(0)).alias("col_email"),
        *[F.col(f"col_{f}") for f in HEADERS if f != "email"],
    )


def parse_lines(lines: DataFrame, tlds: Iterable[str] | None = None, default_company: str | None = None) -> DataFrame:
    """(file, line, raw, raw_email, name, job_title, company, phone, linkedin) per data line."""
    ensure_checkpoint_dir(lines.sparkSession)
    layout = list_layout(lines, tlds).checkpoint(eager=True)
    # By the sizes of the files Spark may take the lines for the smaller side, and then reads them all in each task.
    small = layout.count() <= BROADCAST_FILES
    rows = lookup(lines, F.broadcast(layout) if small else layout, "file", "inner").where(
        ~(F.col("has_header") & (F.col("line") == 1))
    )
    rows = rows.withColumn("cells", cells(F.col("value"), F.col("delimiter")))

    def cell(field: str) -> Column:
        at = F.col(f"col_{field}")
        return F.when(at >= 0, F.get("cells", at))

    picked = F.coalesce(cell("email"), F.lit(""))
    other = F.get(F.filter("cells", lambda c: c.contains("@")), F.lit(0))
    bracket_name = F.trim(F.regexp_replace(F.regexp_extract("value", NAMED_ADDRESS, 1), "[\"']", ""))
    bracket_mail = F.regexp_extract("value", NAMED_ADDRESS, 2)
    company = F.when(F.col("col_company") >= 0, cell("company")).otherwise(F.lit(default_company).cast("string"))
    return rows.select(
        "file", "line", F.col("value").alias("raw"),
        F.when(F.length(bracket_mail) > 0, bracket_mail)
        .when(picked.contains("@"), picked)
        .otherwise(F.coalesce(F.when(F.size("cells") > 1, other), picked))
        .alias("raw_email"),
        F.coalesce(blank_to_null(bracket_name), blank_to_null(cell("name"))).alias("name"),
        blank_to_null(cell("title")).alias("job_title"),
        blank_to_null(company).alias("company"),
        blank_to_null(cell("phone")).alias("phone"),
        blank_to_null(cell("linkedin")).alias("linkedin"),
        F.col("format"),
    )


def parse_json_documents(docs: DataFrame, default_company: str | None = None) -> DataFrame:
    """Items of JSON lists: docs(file, value) -> rows shaped like ``parse_lines``.

    Takes an array, or an object whose emails, records or contacts is one.
    Documents that are not such JSON yield no rows (see ``import_documents``).
    """
    parsed = docs.select("file", F.try_parse_json("value").alias("doc"))

    def array_at(path: str) -> Column:
        return F.try_variant_get("doc", path, "array<variant>")

    items = F.coalesce(*[array_at(p) for p in ("$", *[f"$.{k}" for k in LIST_KEYS])])
    rows = parsed.select("file", F.posexplode_outer(items).alias("pos", "item")).where(F.col("pos").isNotNull())
    rows = rows.select("file", (F.col("pos") + 1).cast("bigint").alias("line"), "item", F.to_json("item").alias("raw"))
    return _json_items(rows, default_company)


def parse_json_lines(lines: DataFrame, default_company: str | None = None) -> DataFrame:
    """One item per line of lines(file, line, value); what does not parse keeps its text and has no address."""
    rows = lines.select("file", "line", F.try_parse_json("value").alias("item"), F.col("value").alias("raw"))
    return _json_items(rows, default_company)


def _json_items(rows: DataFrame, default_company: str | None) -> DataFrame:
    def text(*keys: str) -> Column:
        return F.coalesce(*[blank_to_null(F.try_variant_get("item", f"$.{k}", "string")) for k in keys])

    is_text = F.schema_of_variant("item") == "STRING"
    first, last = text("firstName"), text("lastName")
    whole = F.when(first.isNotNull(), F.trim(F.concat_ws(" ", first, last)))
    return rows.select(
        "file", "line", "raw",
        F.coalesce(F.when(is_text, F.try_variant_get("item", "$", "string")).otherwise(text(*JSON_KEYS["email"])), F.lit("")).alias("raw_email"),
        F.coalesce(text(*JSON_KEYS["name"]), whole).alias("name"),
        text(*JSON_KEYS["title"]).alias("job_title"),
        F.coalesce(text(*JSON_KEYS["company"]), F.lit(default_company).cast("string")).alias("company"),
        text(*JSON_KEYS["phone"]).alias("phone"),
        F.coalesce(text("linkedin"), blank_to_null(F.try_variant_get("item", "$.socials.linkedin", "string"))).alias("linkedin"),
        F.try_variant_get("item", "$.tags", "array<string>").alias("tags"),
        F.lit("json").alias("format"),
    )


def normalise_import(
    rows: DataFrame,
    default_company: str | None = None,
    source_name: str = "Imported List",
    job_id: str | None = None,
    allow_invalid_syntax: bool = False,
    discovered_at: Column | None = None,
    tlds: Iterable[str] | None = None,
) -> DataFrame:
    """Rows of any importer as contacts; ``reject_reason`` is null for accepted rows."""
    stripped = F.regexp_replace(strip_ws(F.col("raw_email")), "^<|>$", "")
    base = rows.withColumn("email", A.normalise(stripped))
    e = F.col("email")
    domain = A.domain_of(e)
    syntax, tld = A.has_import_syntax(e), A.has_valid_tld(e, tlds)
    empty_reason = F.when(F.col("format") == "json", K.IMPORT_REJECTS["no_json_email"]).otherwise(K.IMPORT_REJECTS["no_email"])
    reason = F.when(F.length("raw_email") == 0, empty_reason).when(
        ~e.contains("@"), K.IMPORT_REJECTS["no_at"]
    )
    if not allow_invalid_syntax:
        reason = reason.when(~syntax, K.IMPORT_REJECTS["syntax"]).when(~tld, K.IMPORT_REJECTS["tld"])
    role = A.is_role_address(e)
    company = F.coalesce("company", F.lit(default_company).cast("string"))
    tags = F.col("tags") if "tags" in rows.columns else F.lit(None).cast("array<string>")
    return base.select(
        "file", "line", "raw", "raw_email", "format",
        reason.alias("reject_reason"),
        "email",
        domain.alias("domain"),
        F.when(role, "role").otherwise("personal").alias("type"),
        F.lit(source_name).alias("source_url"),
        F.when(company.isNotNull(), F.concat(company, F.lit(" Contact"))).otherwise("Imported Contact").alias("page_title"),
        (discovered_at if discovered_at is not None else F.current_timestamp()).alias("discovered_at"),
        F.coalesce("name", A.infer_name(e)).alias("name"),
        F.coalesce("job_title", F.when(role, "Department Desk")).alias("job_title"),
        company.alias("company"),
        "phone",
        F.struct(
            F.col("linkedin").alias("linkedin"), F.lit(None).cast("string").alias("twitter"), F.lit(None).cast("string").alias("github")
        ).alias("socials"),
        F.when(A.is_disposable(domain), "disposable").otherwise("pending").alias("mx_status"),
        F.struct(syntax.alias("syntax"), tld.alias("tld"), A.is_disposable(domain).alias("is_disposable")).alias("validity"),
        F.when(role, 85).otherwise(95).alias("import_confidence"),
        A.category(e, domain).alias("email_category"),
        (F.lit(job_id) if job_id else F.concat(F.lit("import_"), F.substring(F.md5("file"), 1, 8))).alias("job_id"),
        F.coalesce(tags, F.array(F.lit("imported"))).alias("tags"),
        F.lit("bulk_import").alias("extraction_method"),
    )


def import_summary(normalised: DataFrame, max_errors: int = MAX_ERRORS, shown_chars: int = SHOWN_CHARS) -> DataFrame:
    """One row per file: total, valid (unique), invalid, duplicates, first errors.

    The report shows ``max_errors`` lines, each up to ``shown_chars``; rejected rows are kept whole.
    """
    ok = F.col("reject_reason").isNull()
    ensure_checkpoint_dir(normalised.sparkSession)
    shown = F.struct("line", F.substring("raw", 1, shown_chars).alias("raw"), F.col("reject_reason").alias("reason"))
    # Rows are parsed once: addresses collapse, rejected lines stay, and both counts and errors are taken from that.
    groups = (
        normalised.groupBy("file", F.when(ok, F.col("email")).alias("__e"), F.when(~ok, shown).alias("__error"))
        .agg(F.count("*").alias("__n"))
        .checkpoint(eager=True)
    )
    totals = groups.groupBy("file").agg(
        F.sum("__n").alias("total_rows"),
        F.count("__e").alias("valid"),
        F.coalesce(F.sum(F.when(F.col("__e").isNull(), F.col("__n"))), F.lit(0)).alias("invalid"),
        F.coalesce(F.sum(F.when(F.col("__e").isNotNull(), F.col("__n") - 1)), F.lit(0)).alias("duplicates"),
    )
    w = Window.partitionBy("file").orderBy("__error.line")
    # The ten smallest lines per file are kept per task; a line given twice is shown twice.
    errors = (
        groups.where(F.col("__error").isNotNull())
        .select("file", F.explode(F.array_repeat("__error", F.least("__n", F.lit(max_errors)).cast("int"))).alias("__error"))
        .withColumn("__i", F.row_number().over(w))
        .where(F.col("__i") <= max_errors)
        .groupBy("file")
        .agg(F.sort_array(F.collect_list("__error")).alias("errors"))
    )
    return totals.join(errors, "file", "left")


def finish_import(rows: DataFrame, **options) -> ImportResult:
    """Normalise, deduplicate (first line wins) and report."""
    normalised = normalise_import(rows, **options)
    accepted = first_per_key(
        normalised.where(F.col("reject_reason").isNull()), ["file", "email"], ["line"]
    ).drop("raw", "raw_email", "reject_reason", "format")
    rejected = normalised.where(F.col("reject_reason").isNotNull()).select(
        "file", "line", F.when(F.length("raw_email") > 0, F.col("raw_email")).otherwise(F.col("raw")).alias("raw"),
        F.col("reject_reason").alias("reason"),
    )
    return ImportResult(accepted, rejected, normalised)


def import_contacts_csv(spark: SparkSession, path: str, tlds: Iterable[str] | None = None, **options) -> ImportResult:
    """Delimited lists with or without a header; each file finds its own layout."""
    rows = parse_lines(read_lines(spark, path), tlds, options.get("default_company"))
    return finish_import(rows, tlds=tlds, **options)


# Plain lists take the same road: one cell per line, "Name <mail>" understood.
import_contacts_text = import_contacts_csv


def parse_json_files(spark: SparkSession, path: str, default_company: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, files): items of JSON lists read in splits, shaped like ``parse_lines``, and the files that are JSON.

    A file counts as JSON if it is one document and all its elements parse, as if it were read whole.
    """
    elements, documents = json_elements(spark, path, LIST_LEVELS)
    doc = documents.withColumn("doc", F.try_parse_json("text")).withColumn("keys", F.json_object_keys("text"))

    def is_array(at: str) -> Column:
        return F.try_variant_get("doc", at, "array<variant>").isNotNull()

    first = F.coalesce(*[F.when(is_array(f"$.{k}"), F.array_position("keys", k) - 1) for k in LIST_KEYS])
    doc = doc.select("file", F.col("doc").isNotNull().alias("good"), F.when(is_array("$"), F.lit(0)).otherwise(first).alias("list"))
    member = F.col("container") == "{"
    item = F.try_parse_json(F.when(member, F.concat(F.lit("{"), "text", F.lit("}"))).otherwise(F.col("text")))
    parsed = elements.withColumn("item", F.when(F.length(F.trim("text", F.lit(" \t\r\n"))) > 0, item))
    broken = parsed.where("item is null").select("file").distinct()
    files = doc.groupBy("file").agg(F.count("*").alias("n"), F.min("good").alias("good"), F.max("list").alias("list"))
    files = files.where("n = 1 and good").join(broken, "file", "left_anti").select("file", "list").checkpoint(eager=True)
    items = lookup(parsed.where(~member), files, "file", "inner").where(F.col("member") == F.col("list"))
    rows = items.select("file", (F.col("ord") + 1).alias("line"), "item", F.to_json("item").alias("raw"))
    return _json_items(rows, default_company), files.select("file")


def import_contacts_json(spark: SparkSession, path: str, tlds: Iterable[str] | None = None, **options) -> ImportResult:
    """JSON lists of any size, read in splits; files that do not parse as such are read as JSON lines or delimited text."""
    company = options.get("default_company")
    items, files = parse_json_files(spark, path, company)
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    # As many names as the listing that the driver holds anyway.
    rest = [unquote(r.file) for r in listed.join(files, "file", "left_anti").collect()]
    if not rest:
        return finish_import(items, tlds=tlds, **options)
    lines = read_lines(spark, rest)
    top = lines.where("line <= 2").groupBy("file").agg(
        F.min_by("value", "line").alias("l1"), F.max(F.when(F.col("line") == 2, F.col("value"))).alias("l2")
    )
    many = F.col("l1").startswith("{") & F.col("l1").endswith("}") & F.col("l2").startswith("{")
    lines = lookup(lines, top.select("file", F.coalesce(many, F.lit(False)).alias("many")), "file", "inner")
    each = parse_json_lines(lines.where("many").drop("many"), company)
    text_rows = parse_lines(lines.where("not many").drop("many"), tlds, company).withColumn("tags", F.lit(None).cast("array<string>"))
    return finish_import(items.unionByName(each).unionByName(text_rows), tlds=tlds, **options)


def import_contacts_jsonl(spark: SparkSession, path: str, tlds: Iterable[str] | None = None, **options) -> ImportResult:
    """JSON lines: one contact per line, read in splits; a line that is no contact is rejected."""
    return finish_import(parse_json_lines(read_lines(spark, path), options.get("default_company")), tlds=tlds, **options)
