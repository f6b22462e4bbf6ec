"""Registered source and import queries."""

import uuid

from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.plans import ducksql as D
from contactlake.plans import seeds as S
from contactlake.plans.registry import query
from contactlake.session import shared_dir
from contactlake.sources import corpus, imports, stores


@query(
    "s1_read_pages",
    """select page_id, url, length(html)::int as n_chars from pages where page_id % 4 <> 2""",
)
def s1(spark, sf):
    """Pages with content types derived from their ids; PDFs drop out."""
    kinds = F.element_at(F.array(F.lit("text/html; charset=utf-8"), F.lit(None), F.lit("application/pdf"), F.lit("application/XHTML+xml")), (F.col("page_id") % 4 + 1).cast("int"))
    pages = corpus.read_pages(spark, f"{sf}/pages.parquet").withColumn("content_type", kinds)
    return corpus.keep_html(pages).select("page_id", "url", F.length("html").alias("n_chars"))


@query("s2_read_texts", "select doc_id as page_id, source as url, 'Direct Text Extraction' as title, length(text)::int as n_chars from documents")
def s2(spark, sf):
    return corpus.read_texts(spark, f"{sf}/documents.parquet").select("page_id", "url", "title", F.length("html").alias("n_chars"))


# Lists cut from the contact seed: thirty files in three delimiters, a header on line 1.
_FILES = 30


def _list_lines(spark, sf):
    seed = S.contacts(spark, sf, "orders").withColumn("f", F.col("contact_id") % _FILES)
    d = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t")), (F.col("f") % 3 + 1).cast("int"))
    name = F.concat(F.lit('"Reyes'), d, F.lit(' ""D"" '), F.col("contact_id").cast("string"), F.lit('"'))
    mail = F.when(F.col("contact_id") % 19 == 0, "no-address").when(F.col("contact_id") % 23 == 0, F.concat(F.lit("Kim Lee <"), "email", F.lit(">"))).otherwise(F.col("email"))
    title = F.when(F.col("contact_id") % 2 == 0, "Lead").otherwise("")
    body = seed.select(
        F.concat(F.lit("list"), F.col("f").cast("string")).alias("file"), (F.floor(F.col("contact_id") / _FILES) + 2).alias("line"),
        F.concat_ws("", mail, d, name, d, title).alias("value"),
    )
    heads = seed.select("f", d.alias("d")).distinct().select(
        F.concat(F.lit("list"), F.col("f").cast("string")).alias("file"), F.lit(1).cast("bigint").alias("line"),
        F.concat_ws("", F.lit("E-Mail"), "d", F.lit("Full Name"), "d", F.lit("Title")).alias("value"),
    )
    return heads.unionByName(body)


_DATA = f"""{S.contacts_cte('orders')}, raw as (select contact_id, 'list' || (contact_id % {_FILES}) as file, (contact_id // {_FILES} + 2)::bigint as line,
  list_extract([',', ';', chr(9)], (contact_id % {_FILES} % 3 + 1)::int) as d, email from contacts),
 rows_ as (select file, line, case when contact_id % 19 = 0 then 'no-address' else email end as mail,
  case when contact_id % 23 = 0 and contact_id % 19 <> 0 and regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') then 'Kim Lee' else 'Reyes' || d || ' "D" ' || contact_id end as name,
  case when contact_id % 2 = 0 then 'Lead' else '' end as title, contact_id % 23 = 0 and contact_id % 19 <> 0 as bracketed from raw)"""


@query(
    "s3_import_csv",
    f"with {_DATA} select file, line, case when bracketed and name <> 'Kim Lee' then 'Kim Lee <' || mail || '>' else mail end as raw_email, name, title as job_title from rows_",
)
def s3(spark, sf):
    out = imports.parse_lines(_list_lines(spark, sf))
    return out.select("file", "line", "raw_email", "name", F.coalesce("job_title", F.lit("")).alias("job_title"))


_REJECT = f"""case when not contains(mail, '@') then 'Missing "@" symbol or empty email' when not regexp_matches(mail, {D.lit(D.IMPORT_SYNTAX)}) then 'Invalid email syntax format'
 when not {D.valid_tld('mail')} then 'Invalid or unrecognized Top-Level Domain (TLD)' else '' end"""
_BROKEN = "case when bracketed and name <> 'Kim Lee' then 'kim lee <' || mail else mail end"
_NORM = f"norm as (select file, line, name, title, {_BROKEN} as mail from rows_), chk as (select *, {_REJECT} as reason from norm)"


@query(
    "s6_normalise_import",
    f"""with {_DATA}, {_NORM} select file, line, mail as email, reason as reject_reason, case when {D.role('mail')} then 'role' else 'personal' end as type, name,
    coalesce(nullif(title, ''), case when {D.role('mail')} then 'Department Desk' end, '') as job_title, 'Acme Contact' as page_title,
    case when split_part(mail, '@', 2) in {D.in_list(K.DISPOSABLE_DOMAINS)} then 'disposable' else 'pending' end as mx_status,
    case when {D.role('mail')} then 85 else 95 end as import_confidence from chk""",
)
def s6(spark, sf):
    rows = imports.parse_lines(_list_lines(spark, sf), default_company="Acme")
    out = imports.normalise_import(rows, discovered_at=F.lit("x"))
    return out.select(
        "file", "line", "email", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"), "type", "name",
        F.coalesce("job_title", F.lit("")).alias("job_title"), "page_title", "mx_status", "import_confidence",
    )


@query(
    "s7_import_summary",
    f"""with {_DATA}, {_NORM}, er as (select *, row_number() over (partition by file order by line) as rn from chk where reason <> ''),
    ee as (select file, string_agg(line || ' ' || reason, ';' order by line) as errors from er where rn <= 10 group by 1)
    select chk.file, count(*)::bigint as total_rows, count(distinct case when reason = '' then mail end)::bigint as valid, (count(*) filter (where reason <> ''))::bigint as invalid,
    ((count(*) filter (where reason = '')) - count(distinct case when reason = '' then mail end))::bigint as duplicates, coalesce(any_value(errors), '') as errors from chk left join ee on chk.file = ee.file group by 1""",
)
def s7(spark, sf):
    result = imports.finish_import(imports.parse_lines(_list_lines(spark, sf)), discovered_at=F.lit("x"))
    texts = F.transform("errors", lambda e: F.concat(e["line"].cast("string"), F.lit(" "), e["reason"]))
    return result.summary.withColumn("errors", F.coalesce(F.array_join(texts, ";"), F.lit("")))


@query(
    "s4_import_json",
    f"""with {S.contacts_cte('orders')} select 'j' || contact_id as file, 1::bigint as line, email as raw_email, 'Dana ' || contact_id as name, case when contact_id % 3 = 0 then 'Org' || contact_id else 'Acme' end as company, '' as phone from contacts
    union all select 'j' || contact_id, 2, 'plain' || contact_id || '@corp.com', '', 'Acme', '' from contacts
    union all select 'j' || contact_id, 3, 'k' || contact_id || '@corp.com', 'Ann B' || contact_id, 'Acme', '555' from contacts
    union all select 'j' || contact_id, 4, '', '', 'Acme', '' from contacts""",
)
def s4(spark, sf):
    c = F.col("contact_id").cast("string")
    q = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    company = F.when(F.col("contact_id") % 3 == 0, F.concat(F.lit(',"organization":"Org'), c, F.lit('"'))).otherwise("")
    items = F.concat(
        F.lit('[{"mail":'), q(F.col("email")), F.lit(',"name":'), q(F.concat(F.lit("Dana "), c)), company, F.lit("},"),
        q(F.concat(F.lit("plain"), c, F.lit("@corp.com"))), F.lit(',{"address":'), q(F.concat(F.lit("k"), c, F.lit("@corp.com"))),
        F.lit(',"firstName":"Ann","lastName":'), q(F.concat(F.lit("B"), c)), F.lit(',"mobile":555},{"x":1}]'),
    )
    wrapped = F.when(F.col("contact_id") % 2 == 0, items).otherwise(F.concat(F.lit('{"emails":3,"contacts":'), items, F.lit("}")))
    docs = S.contacts(spark, sf, "orders").select(F.concat(F.lit("j"), c).alias("file"), wrapped.alias("value"))
    out = imports.parse_json_documents(docs, default_company="Acme")
    return out.select(
        "file", "line", "raw_email", *[F.coalesce(x, F.lit("")).alias(x) for x in ("name", "company", "phone")]
    )


def _write_arrays(items, path):
    """(f, ord, value) as one JSON array per f, one value a line."""
    # Thirty rows of first and last ones; a window would hold a whole file.
    ends = items.join(F.broadcast(items.groupBy("f").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))), "f")
    line = F.concat(
        F.when(F.col("ord") == F.col("first"), "[").otherwise(","), "value", F.when(F.col("ord") == F.col("last"), "]").otherwise("")
    )
    rows = ends.repartition("f").sortWithinPartitions("f", "ord").select("f", line.alias("value"))
    rows.write.partitionBy("f").text(path)


@query(
    "s4_json_array_files",
    f"""with {S.contacts_cte('orders')}, r as (select 'j' || (contact_id % 30) as file, email, contact_id, row_number() over (partition by contact_id % 30 order by contact_id)::bigint as line from contacts)
    select file, line, email as raw_email, 'Dana, [' || contact_id || '}}' as name, '"' as phone from r""",
)
def s4_arrays(spark, sf):
    """Thirty files of one array each, written and read back in splits."""
    path = f"{shared_dir(spark)}/arrays-{uuid.uuid4().hex}"
    quoted = F.to_json(F.struct(F.col("email").alias("mail"), F.concat(F.lit("Dana, ["), F.col("contact_id").cast("string"), F.lit("}")).alias("name"), F.lit('"').alias("tel")))
    items = S.contacts(spark, sf, "orders").select((F.col("contact_id") % 30).alias("f"), F.col("contact_id").alias("ord"), quoted.alias("value"))
    _write_arrays(items, path)
    rows, _ = imports.parse_json_files(spark, path)
    return rows.select(F.concat(F.lit("j"), F.regexp_extract("file", r"f=(\d+)", 1)).alias("file"), "line", "raw_email", "name", "phone")


@query(
    "s8_folder_arrays",
    f"""with {S.contacts_cte('orders')} select (contact_id // 100)::varchar as folder_id, row_number() over (partition by contact_id // 100 order by email)::int - 1 as pos, email, 'personal' as type from contacts""",
)
def s8_arrays(spark, sf):
    """Thirty files of folder arrays; records are read one by one, wherever a split cuts their folder."""
    path = f"{shared_dir(spark)}/folders-{uuid.uuid4().hex}"
    record = F.struct("email", F.lit("personal").alias("type"), F.lit('"}],').alias("name"))
    folders = S.contacts(spark, sf, "orders").groupBy(F.expr("contact_id div 100").alias("ord")).agg(F.sort_array(F.collect_list(record)).alias("records"))
    text = F.to_json(F.struct(F.col("ord").cast("string").alias("id"), F.lit("n").alias("name"), "records", F.array(F.lit("x")).alias("tags")))
    _write_arrays(folders.select((F.col("ord") % 30).alias("f"), "ord", text.alias("value")), path)
    return stores.read_folders(spark, path, multi_line=True)[1].select("folder_id", "pos", "email", "type")


_PLAIN = f"""{S.contacts_cte('orders', S.MIXED_EMAIL)}, p as (select 't' || (contact_id % 30) as file, (contact_id // 30 + 1)::bigint as line, contact_id, lower(email) as email from contacts)"""


@query(
    "s5_import_text",
    f"""with {_PLAIN}, a as (select *, case when regexp_matches(email, {D.lit(D.IMPORT_SYNTAX)}) and {D.valid_tld('email')} then 1 else 0 end as ok from p),
    u as (select file, email, min(line) as line from a where ok = 1 group by 1, 2) select file, line, email from u""",
)
def s5(spark, sf):
    seed = S.contacts(spark, sf, "orders", S.MIXED_EMAIL)
    lines = seed.select(
        F.concat(F.lit("t"), (F.col("contact_id") % 30).cast("string")).alias("file"), (F.floor(F.col("contact_id") / 30) + 1).alias("line"), F.col("email").alias("value")
    )
    return imports.finish_import(imports.parse_lines(lines), discovered_at=F.lit("x")).accepted.select("file", "line", "email")


@query(
    "s5_import_files",
    f"""with {S.contacts_cte('customer', S.MIXED_EMAIL)}, a as (select lower(email) as email from contacts where regexp_matches(lower(email), {D.lit(D.IMPORT_SYNTAX)}) and {D.valid_tld('lower(email)')})
    select email, count(*)::bigint as n from a group by 1""",
)
def s5_files(spark, sf):
    """The same through real files: written as text, read back in splits, numbered, parsed."""
    path = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    S.contacts(spark, sf, "customer", S.MIXED_EMAIL).select(F.concat(F.lit("  "), "email").alias("value")).repartition(4, "value").write.text(path)
    rows = imports.parse_lines(imports.read_lines(spark, path))
    ok = imports.normalise_import(rows, discovered_at=F.lit("x")).where(F.col("reject_reason").isNull())
    return ok.groupBy("email").agg(F.count("*").alias("n"))


@query(
    "s8_read_stores",
    f"""with {S.JOBS_CTE}, {S.contacts_cte('orders')} select 'job' as store, job_id::varchar as id, status as a, epoch_ms(started_at)::varchar as b from jobs
    union all select 'suppression', 's' || contact_id, 'email', email from contacts
    union all select 'record', (contact_id // 100)::varchar, email, 'personal' from contacts
    union all select 'audit', 'x' || contact_id, 'csv', contact_id::varchar from contacts""",
)
def s8(spark, sf):
    """Writes the stores as JSON in their stored shape and reads them back; a folder holds up to a hundred records."""
    base = f"{shared_dir(spark)}/stores-{uuid.uuid4().hex}"
    contacts = S.contacts(spark, sf, "orders")
    S.jobs(spark, sf).select(
        F.col("job_id").cast("string").alias("id"), "status", F.col("owner").alias("ownerId"), F.unix_millis("started_at").alias("startedAt")
    ).write.json(f"{base}/jobs")
    contacts.selectExpr("concat('s', contact_id) as id", "'email' as type", "email as value", "'BOUNCE' as reason").write.json(f"{base}/suppression")
    contacts.groupBy(F.expr("contact_id div 100").cast("string").alias("id")).agg(
        F.lit("n").alias("name"), F.collect_list(F.struct("email", F.lit("personal").alias("type"))).alias("records")
    ).write.json(f"{base}/folders")
    contacts.selectExpr("concat('x', contact_id) as id", "'csv' as format", "contact_id as recordCount").write.json(f"{base}/audit")
    _, records = stores.read_folders(spark, f"{base}/folders")
    text = lambda c: F.col(c).cast("string")
    return (
        stores.read_jobs(spark, f"{base}/jobs").select(F.lit("job").alias("store"), F.col("job_id").alias("id"), F.col("status").alias("a"), F.unix_millis("started_at").cast("string").alias("b"))
        .unionByName(stores.read_suppression(spark, f"{base}/suppression").select(F.lit("suppression").alias("store"), "id", F.col("type").alias("a"), F.col("value").alias("b")))
        .unionByName(records.select(F.lit("record").alias("store"), F.col("folder_id").alias("id"), F.col("email").alias("a"), F.col("type").alias("b")))
        .unionByName(stores.read_audit(spark, f"{base}/audit").select(F.lit("audit").alias("store"), "id", F.col("format").alias("a"), text("record_count").alias("b")))
    )
