"""Registered dataset, CRM and export queries."""

from pyspark.sql import functions as F

from contactlake.operators import crm as H
from contactlake.operators import datasets as A
from contactlake.plans import ducksql as D
from contactlake.plans import seeds as S
from contactlake.plans.registry import query
from contactlake.sinks import exports as K

_RICH = S.rich_cte("orders")


def _rich(spark, sf, source="orders"):
    return S.rich_contacts(spark, sf, source)


def _sides(spark, sf):
    """Folder rows already stored and rows arriving; many addresses in both."""
    rows = _rich(spark, sf).select(
        (F.col("contact_id") % 7).cast("string").alias("folder_id"), "contact_id", F.initcap("email").alias("email"), F.col("contact_id").alias("pos")
    )
    return rows.where("contact_id % 3 < 2"), rows.where("contact_id % 3 > 0")


_BOTH = """rows_ as (select (contact_id % 7)::varchar as folder_id, contact_id, email, contact_id as pos from rich),
 both_ as (select *, 0 as src from rows_ where contact_id % 3 < 2 union all select *, 1 from rows_ where contact_id % 3 > 0)"""


@query(
    "a1_upsert_folder",
    f"""with {_RICH}, {_BOTH}, m as (select folder_id, lower(email) as e, arg_max(contact_id, (src, pos)) as contact_id, min((src, pos)) as tm from both_ group by 1, 2),
    k as (select *, row_number() over (partition by folder_id order by tm, e) as pos from m) select folder_id, e as email, contact_id, pos::int as pos from k """,
)
def a1(spark, sf):
    old, new = _sides(spark, sf)
    return A.upsert_folder(old, new).select("folder_id", F.lower("email").alias("email"), "contact_id", "pos")


@query(
    "a2_merge_session",
    f"""with {_RICH}, {_BOTH} select lower(email) as email, arg_min(contact_id, (src, pos)) as contact_id from both_ group by 1""",
)
def a2(spark, sf):
    old, new = _sides(spark, sf)
    return A.merge_session(old, new).select(F.lower("email").alias("email"), "contact_id")


@query(
    "a3_folder_counts",
    f"""with {_RICH}, f as (select distinct unnest([(contact_id % 17)::varchar, 'e' || (contact_id % 17)]) as folder_id from rich), r as (select (contact_id % 17)::varchar as folder_id from rich)
    select f.folder_id, count(r.folder_id)::bigint as count from f left join r on f.folder_id = r.folder_id group by 1""",
)
def a3(spark, sf):
    rich = _rich(spark, sf)
    name = (F.col("contact_id") % 17).cast("string")
    # Every second folder is empty.
    folders = rich.select(F.explode(F.array(name, F.concat(F.lit("e"), name))).alias("folder_id")).distinct()
    records = rich.select(name.alias("folder_id"))
    return A.folder_counts(folders, records)


@query(
    "a4_folder_edits",
    f"""with {_RICH}, old as (select distinct 'o' || (contact_id % 11) as folder_id, 'List ' || (contact_id % 11) as name from rich),
    w as (select 'w' || contact_id as folder_id, substring(trim(' LIST ' || (contact_id % 23) || ' '), 1, 100) as name, contact_id as ord from rich),
    n as (select arg_min(folder_id, ord) as folder_id, arg_min(name, ord) as name from w where lower(name) not in (select lower(name) from old) group by lower(name))
    select folder_id, name from (select * from old union all select * from n) where folder_id not in ('o3', 'o5')""",
)
def a4(spark, sf):
    rich = _rich(spark, sf)
    old = rich.selectExpr("concat('o', contact_id % 11) as folder_id", "concat('List ', contact_id % 11) as name").distinct()
    wanted = rich.selectExpr("concat('w', contact_id) as folder_id", "concat(' LIST ', contact_id % 23, ' ') as name", "contact_id as ord")
    gone = old.where(F.col("folder_id").isin("o3", "o5")).select("folder_id")
    return A.delete_folders(A.create_folders(old, wanted), gone)


@query(
    "a4_remove_records",
    f"""with {_RICH}, r as (select (contact_id % 7)::varchar as folder_id, contact_id, email from rich), g as (select distinct folder_id, email from r where contact_id % 101 = 0)
    select folder_id, contact_id from r where (folder_id, email) not in (select folder_id, email from g)""",
)
def a4_remove(spark, sf):
    rows = _rich(spark, sf).select((F.col("contact_id") % 7).cast("string").alias("folder_id"), "contact_id", "email")
    gone = rows.where("contact_id % 101 = 0").select("folder_id", F.upper("email").alias("email"))
    return A.remove_records(rows, gone).select("folder_id", "contact_id")


@query("a5_quarantine", f"with {_RICH} select contact_id, (mx_status in ('undeliverable', 'disposable'))::int as dead from rich")
def a5(spark, sf):
    kept, dead = A.quarantine(_rich(spark, sf), ("undeliverable", "disposable"))
    return kept.select("contact_id", F.lit(0).alias("dead")).unionByName(dead.select("contact_id", F.lit(1).alias("dead")))


_RISK = "coalesce(is_catch_all, false)"
_SEG = {
    "clean": f"mx_status = 'deliverable' and not {_RISK}",
    "suppression": "mx_status in ('undeliverable', 'disposable')",
    "risky": f"mx_status = 'risky' or {_RISK}",
}
_SEG_SQL = " union all ".join(f"select '{n}' as segment, contact_id from rich where {c}" for n, c in _SEG.items())


@query("a6_segment", f"with {_RICH} {_SEG_SQL}")
def a6(spark, sf):
    rich, out = _rich(spark, sf), None
    for name in _SEG:
        part = A.segment(rich, name).select(F.lit(name).alias("segment"), "contact_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "a7_segment_counts",
    f"with {_RICH} select " + ", ".join(f"(count(*) filter (where {c}))::bigint as {n}" for n, c in _SEG.items()) + ', count(*)::bigint as "all" from rich',
)
def a7(spark, sf):
    return A.segment_counts(_rich(spark, sf))


@query(
    "a8_contact_kpis",
    f"""with {S.rich_cte('lineitem', S.MIXED_EMAIL)} select count(*)::bigint as total, (count(*) filter (where type = 'personal'))::bigint as personal, (count(*) filter (where type = 'role'))::bigint as role,
    count(distinct domain)::bigint as domains, (count(*) filter (where mx_status = 'deliverable'))::bigint as deliverable from rich""",
)
def a8(spark, sf):
    return A.contact_kpis(S.rich_contacts(spark, sf, "lineitem", S.MIXED_EMAIL))


@query("a9_domain_facets", f"with {S.rich_cte('lineitem', S.MIXED_EMAIL)} select domain, count(*)::bigint as count from rich group by 1")
def a9(spark, sf):
    return A.domain_facets(S.rich_contacts(spark, sf, "lineitem", S.MIXED_EMAIL))


@query(
    "a10_search_contacts",
    f"""with {_RICH} select 'session' as form, contact_id from rich where type = 'role' and domain = 'gmail.com' and (contains(email, 'in') or contains(lower(page_title), 'in') or contains(lower(context_snippet), 'in') or contains(domain, 'in'))
    union all select 'directory', contact_id from rich where contains(email, 'doe') or contains(lower(coalesce(name, '')), 'doe') or contains(domain, 'doe')
    union all select 'results', contact_id from rich where (contains(email, 'team') or contains(lower(coalesce(name, '')), 'team') or contains(domain, 'team') or contains(lower(coalesce(source_url, '')), 'team'))
     and lower(coalesce(email_category, case when type = 'personal' then 'Personal' else 'General' end)) = 'personal' and mx_status <> 'deliverable' and (job_id is null or job_id = '3')""",
)
def a10(spark, sf):
    rich = _rich(spark, sf)
    found = {
        "session": A.search_contacts(rich, "IN", "session", type_="role", domain="gmail.com"),
        "directory": A.search_contacts(rich, "Doe", "directory"),
        "results": A.search_contacts(rich, "team", "results", category="Personal", status="invalid", job="3"),
    }
    out = None
    for form, rows in found.items():
        part = rows.select(F.lit(form).alias("form"), "contact_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "a11_page_of",
    f"with {_RICH} select contact_id, email, 3 as page, ceil((select count(*) from rich) / 40.0)::int as total_pages from rich order by email, contact_id limit 40 offset 80",
)
def a11(spark, sf):
    return A.page_of(_rich(spark, sf).select("email", "contact_id"), ["email", "contact_id"], page=3, size=40)


@query(
    "a11_page_after",
    f"with {_RICH} select contact_id, email from rich where (email, contact_id) > ('info@', 0) order by email, contact_id limit 40",
)
def a11_after(spark, sf):
    return A.page_after(_rich(spark, sf).select("contact_id", "email"), ["email", "contact_id"], ("info@", 0), size=40)


@query("a12_select_contacts", f"with {_RICH} select contact_id from rich where email in (select email from rich where contact_id % 43 = 0)")
def a12(spark, sf):
    rich = _rich(spark, sf)
    return A.select_contacts(rich, rich.where("contact_id % 43 = 0").select("email")).select("contact_id")


@query(
    "a13_project_fields",
    f"""with {_RICH} select email as "Email", coalesce(linkedin, '') as "LinkedIn Profile", mx_status as "MX Deliverability" from rich""",
)
def a13(spark, sf):
    out = A.project_fields(_rich(spark, sf), ["email", "linkedin", "mxStatus"])
    return out.withColumn("LinkedIn Profile", F.coalesce("LinkedIn Profile", F.lit("")))


@query("a14_list_jobs", f"with {S.JOBS_CTE} select job_id, status from jobs where owner = '7' order by started_at desc, job_id desc limit 500")
def a14(spark, sf):
    return A.list_jobs(S.jobs(spark, sf), owner="7", limit=500).select("job_id", "status")


@query(
    "a15_job_metrics",
    f"""with {S.JOBS_CTE} select (count(*) filter (where status = 'queued'))::bigint as queued, (count(*) filter (where status = 'running'))::bigint as running,
    (count(*) filter (where status = 'completed'))::bigint as completed, 0::bigint as cancelled, 0::bigint as failed, (count(*) filter (where status = 'completed'))::bigint as total_processed from jobs""",
)
def a15(spark, sf):
    return A.job_metrics(S.jobs(spark, sf))


@query(
    "a16_recover_stale",
    f"""with {S.JOBS_CTE} select job_id, case when status = 'completed' then status when retry_count < max_retries then 'queued' else 'failed' end as status,
    (retry_count + case when status <> 'completed' and retry_count < max_retries then 1 else 0 end)::int as retry_count, (status <> 'completed')::int as recovered,
    coalesce(case when status = 'completed' then epoch_ms(ended_at) when retry_count < max_retries then null else epoch_ms(timestamp '2000-01-01') end, -1)::bigint as ended_ms from jobs""",
)
def a16(spark, sf):
    out = A.recover_stale(S.jobs(spark, sf), F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return out.select(
        "job_id", "status", "retry_count", F.col("recovered").cast("int").alias("recovered"),
        F.coalesce(F.unix_millis("ended_at"), F.lit(-1)).cast("bigint").alias("ended_ms"),
    )


_MOVES = f"""{S.JOBS_CTE}, mv as (select job_id, owner, is_browser, started_at as tm, 1 as delta from jobs union all select job_id, owner, is_browser, ended_at, -1 from jobs where ended_at is not null),
 pr as (select *, sum(delta) over (order by tm, delta, job_id rows unbounded preceding) as g, sum(delta) over (partition by owner order by tm, delta, job_id rows unbounded preceding) as u,
  sum(case when is_browser then delta else 0 end) over (partition by owner order by tm, delta, job_id rows unbounded preceding) as b from mv)"""


@query(
    "a17_concurrency_profile",
    f"with {_MOVES} select job_id, delta::int as delta, g::bigint as global_active, u::bigint as user_active, b::bigint as user_browser_active, (u > 3)::int as over_user, (g > 10)::int as over_global from pr",
)
def a17(spark, sf):
    out = A.concurrency_profile(S.jobs(spark, sf))
    return out.select(
        "job_id", "delta", "global_active", "user_active", "user_browser_active",
        F.col("over_user").cast("int").alias("over_user"), F.col("over_global").cast("int").alias("over_global"),
    )


_SOURCE = """case when coalesce(source_url, '') = '' then 'RAW_TEXT' when contains(lower(source_url), '/contact') then 'CONTACT_PAGE' when contains(lower(source_url), '/team') then 'TEAM_PAGE'
 when contains(lower(source_url), '/about') then 'ABOUT_PAGE' when contains(lower(source_url), 'footer') then 'FOOTER' when starts_with(source_url, 'http') then 'WEBSITE' else 'OTHER' end"""


@query("h1_classify_source", f"with {_RICH} select contact_id, {_SOURCE} as source_type from rich")
def h1(spark, sf):
    return H.classify_source(_rich(spark, sf)).select("contact_id", "source_type")


_SCORE = """least(99, greatest(10, 70 + case mx_status when 'deliverable' then 20 when 'disposable' then -40 when 'undeliverable' then -50 else 0 end
 + case when coalesce(job_title, '') <> '' then 5 else 0 end + case when coalesce(phone, '') <> '' then 3 else 0 end + case when coalesce(linkedin, twitter, '') <> '' then 5 else 0 end)) / 100.0::double"""


@query("h2_score_confidence", f"with {_RICH} select contact_id, {_SCORE} as evidence_confidence from rich")
def h2(spark, sf):
    return H.score_confidence(_rich(spark, sf)).select("contact_id", "evidence_confidence")


@query(
    "h3_map_status_type",
    f"""with {_RICH} select contact_id, case mx_status when 'deliverable' then 'VALIDATED' when 'undeliverable' then 'UNVERIFIED' when 'disposable' then 'UNVERIFIED' else 'FOUND' end as email_status,
    case type when 'personal' then 'PERSONAL' else 'ROLE_BASED' end as email_type from rich""",
)
def h3(spark, sf):
    return H.map_status_type(_rich(spark, sf)).select("contact_id", "email_status", "email_type")


_INFERRED = "coalesce(name, '') <> '' and regexp_replace(lower(name), '\\s+', '', 'g') = regexp_replace(lower(split_part(email, '@', 1)), '[._\\-+]', '', 'g')"


@query(
    "h4_split_identity",
    f"""with {_RICH} select contact_id, case when {_INFERRED} then string_split(name, ' ')[1] else '' end as first_name,
    case when {_INFERRED} then array_to_string(string_split(name, ' ')[2:], ' ') else '' end as last_name,
    case when {_INFERRED} then 'inferred' when coalesce(name, '') <> '' then 'website' else '' end as identity_source,
    case when not ({_INFERRED}) then coalesce(name, '') else '' end as verified_name from rich""",
)
def h4(spark, sf):
    out = H.split_identity(_rich(spark, sf))
    e = F.lit("")
    return out.select(
        "contact_id", F.coalesce("identity_inference.first_name", e).alias("first_name"), F.coalesce("identity_inference.last_name", e).alias("last_name"),
        F.coalesce("identity_source", e).alias("identity_source"), F.coalesce("verified_name", e).alias("verified_name"),
    )


@query(
    "h5_crm_contacts",
    f"""with {_RICH} select contact_id, lower(email) as email, {_SCORE} as confidence, {_SOURCE} as source_type, case when not ({_INFERRED}) then coalesce(nullif(name, ''), '') else '' end as name from rich""",
)
def h5(spark, sf):
    out = H.crm_contacts(_rich(spark, sf))
    return out.select(
        "contact_id", "contact.email", "contact.confidence", F.col("contact.sourceType").alias("source_type"), F.coalesce("contact.name", F.lit("")).alias("name")
    )


_BATCHES = "select *, case when contact_id % 2 = 0 then 'mix' || (contact_id % 5) else 'solo' || domain end as batch from rich"


def payloads(spark, sf):
    rich = _rich(spark, sf).withColumn(
        "batch", F.expr("case when contact_id % 2 = 0 then concat('mix', contact_id % 5) else concat('solo', domain) end")
    )
    return H.crm_payloads(rich, by="batch", part_size=200)


@query(
    "h6_crm_payloads",
    f"""with {_RICH}, b as ({_BATCHES}) select batch, count(distinct lower(email))::bigint as contacts, case when min(domain) = max(domain) then min(domain) else '' end as company_domain,
    ceil(count(distinct lower(email)) / 200.0)::int as parts from b group by 1""",
)
def h6(spark, sf):
    return payloads(spark, sf).groupBy("batch").agg(
        F.sum("contact_count").alias("contacts"), F.coalesce(F.max("company_domain"), F.lit("")).alias("company_domain"), F.max("parts").alias("parts"),
    )


_STATUS = "case mx_status when 'deliverable' then 'VALIDATED' when 'undeliverable' then 'UNVERIFIED' when 'disposable' then 'UNVERIFIED' else 'FOUND' end"


@query(
    "h6_payload_json",
    f"""with {_RICH}, b as ({_BATCHES}), f as (select *, row_number() over (partition by batch, lower(email) order by ord) as rn from b)
    select batch, lower(email) as email, {_STATUS} as email_status, {_SCORE} as confidence, coalesce(phone, '') as phone, coalesce(linkedin, '') as linkedin,
    case when {_INFERRED} then string_split(name, ' ')[1] else '' end as first_name, '1.0' as version from f where rn = 1""",
)
def h6_json(spark, sf):
    """Contacts as a receiver reads them from the payload documents."""
    contact = (
        "struct<email:string,emailStatus:string,confidence:double,phone:string,socials:struct<linkedin:string>,"
        "identityInference:struct<firstName:string>>"
    )
    docs = payloads(spark, sf).select(
        "batch", F.from_json("payload", f"version string, contacts array<{contact}>").alias("p")
    ).select("batch", "p.version", F.explode("p.contacts").alias("c"))
    e = F.lit("")
    return docs.select(
        "batch", "c.email", F.col("c.emailStatus").alias("email_status"), "c.confidence", F.coalesce("c.phone", e).alias("phone"),
        F.coalesce("c.socials.linkedin", e).alias("linkedin"), F.coalesce("c.identityInference.firstName", e).alias("first_name"), "version",
    )


@query(
    "h7_sync_ledger",
    f"""with {_RICH}, b as ({_BATCHES}), n as (select batch, count(distinct lower(email)) as c from b group by 1)
    select sum(c) filter (where batch not like 'mix%')::bigint as accepted, 0::bigint as rejected from n""",
)
def h7(spark, sf):
    rows = payloads(spark, sf)
    return H.sync_ledger(rows, rows.where(F.col("batch").startswith("mix")).select("request_id")).select("accepted", "rejected")


def _cell(expr: str) -> str:
    flat = f"regexp_replace(replace(coalesce({expr}, ''), '\"', '\"\"'), '[\\r\\n]+', ' ', 'g')"
    return f"'\"' || case when regexp_matches({flat}, '^[=+\\-@\\t\\r]') then '''' || {flat} else {flat} end || '\"'"


_CSV = " || ',' || ".join(
    _cell(c) for c in ("email", "name", "job_title", "case when coalesce(is_catch_all, false) then 'Yes (Accept-All Gateway)' else 'No' end", "linkedin", "context_snippet")
)
_FIELDS = ["email", "name", "jobTitle", "isCatchAll", "linkedin", "contextSnippet"]


@query("k1_csv_lines", f"with {_RICH} select {_CSV} as value from rich")
def k1(spark, sf):
    return K.csv_lines(_rich(spark, sf), _FIELDS)


@query(
    "k2_json_lines",
    f"""with {_RICH} select to_json({{email: email, name: coalesce(name, ''), linkedin: coalesce(linkedin, ''), contextSnippet: context_snippet}})::varchar as value from rich""",
)
def k2(spark, sf):
    return K.json_lines(_rich(spark, sf), ["email", "name", "linkedin", "contextSnippet"])


@query("k3_txt_lines", f"with {_RICH} select distinct lower(trim(email)) as value from rich")
def k3(spark, sf):
    return K.txt_lines(_rich(spark, sf))


_NAME = f"coalesce(nullif(name, ''), {D.display_name('email')})"
_NOTE = "concat_ws(' | ', 'Title: ' || nullif(job_title, ''), 'Discovered on: ' || page_title, 'Source: ' || nullif(source_url, ''), 'Snippet: ' || context_snippet)"


@query(
    "k4_vcards",
    f"""with {_RICH} select concat_ws(chr(13) || chr(10), 'BEGIN:VCARD', 'VERSION:3.0', 'FN:' || {_NAME}, 'N:;' || {_NAME} || ';;;', 'TITLE:' || nullif(job_title, ''), 'EMAIL;TYPE=INTERNET,WORK:' || email,
    'TEL;TYPE=WORK,VOICE:' || phone, 'ORG:' || upper(domain), 'URL:' || nullif(source_url, ''), 'NOTE:' || {_NOTE}, 'END:VCARD') as value from rich""",
)
def k4(spark, sf):
    return K.vcards(_rich(spark, sf))


@query(
    "k5_export_selection",
    f"""with {_RICH}, {S.suppression_cte()}, sup as (select *, case when type = 'domain' then regexp_replace(lower(trim(value)), '^@', '') else lower(trim(value)) end as k from suppression)
    select contact_id from rich where ({_SEG['risky']}) and lower(email) not in (select k from sup where type = 'email') and domain not in (select k from sup where type = 'domain')
    and sha256(lower(email)) not in (select k from sup where type = 'sha256') and md5(lower(email)) not in (select k from sup where type = 'md5')""",
)
def k5(spark, sf):
    entries = S.suppression(spark, sf, "orders")
    return K.export_selection(_rich(spark, sf), "risky", entries).select("contact_id")


@query(
    "k5_export_roundtrip",
    f"""with {_RICH}, r as (select {_CSV} as value from rich where {_SEG['clean']}) select value from r""",
)
def k5_roundtrip(spark, sf):
    """Writes the clean segment as CSV and reads the files back without header and BOM."""
    import uuid

    from contactlake.session import shared_dir

    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    K.export_contacts(_rich(spark, sf), path, "csv", "clean", _FIELDS)
    lines = spark.read.option("lineSep", "\r\n").text(path)
    return lines.where(~F.col("value").endswith(K.csv_header(_FIELDS)) & (F.length("value") > 0))

