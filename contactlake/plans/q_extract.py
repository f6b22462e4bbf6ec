"""Registered extraction queries (X1-X13) and the flagship."""

from pyspark.sql import functions as F

from contactlake.functions import addresses as A
from contactlake.functions import text as T
from contactlake.operators import extraction as X
from contactlake.plans import contacts as P
from contactlake.plans import ducksql as D
from contactlake.plans import seeds as S
from contactlake.plans.registry import query


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


def corpus(spark, sf):
    """Documents and pages as one text corpus: source, id, text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("concat('d', doc_id) as id", "text")
    pages = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("concat('p', page_id) as id", "html as text")
    return docs.unionByName(pages)


_CORPUS = "corpus as (select 'd' || doc_id as id, text from documents union all select 'p' || page_id, html from pages)"
_FOUND = (
    f"decoded as (select id, {D.deobfuscate('text')} as t from corpus), "
    f"found as (select id, unnest({D.valid_emails('t')}) as email from decoded)"
)


@query(
    "x1_deobfuscate",
    f"select doc_id, md5({D.deobfuscate('text')}) as decoded_md5 from documents",
)
def x1(spark, sf):
    return X.deobfuscate(_docs(spark, sf), "text").select("doc_id", F.md5("decoded").alias("decoded_md5"))


@query("x2_extract_emails", f"with {_CORPUS}, {_FOUND} select id, email from found")
def x2(spark, sf):
    return X.extract_emails(corpus(spark, sf), "id", "text")


_OWN_TLDS = ("com", "io", "software", "co.uk")
_OWN_RULE = "regexp_matches(lower(split_part(email, '@', 2)), '[^.]\\.(com|io|software)$') or regexp_matches(lower(split_part(email, '@', 2)), '[^.]\\.co\\.uk$')"


@query(
    "x2_explicit_tlds",
    f"with {_CORPUS}, {_FOUND}, mixed as (select id, replace(email, '.org', '.software') as email from found) select id, email from mixed where {_OWN_RULE}",
)
def x2_explicit(spark, sf):
    """Addresses under a caller's own list of domains; one of its names is put in for another first."""
    found = X.extract_emails(corpus(spark, sf), "id", "text").withColumn("email", F.replace("email", F.lit(".org"), F.lit(".software")))
    return X.extract_emails(found, "id", "email", tlds=_OWN_TLDS).where("email is not null")


@query(
    "flagship_domains",
    f"""with {_CORPUS}, {_FOUND}, c as (select id, {D.canonical('email')} as canonical from found)
    select split_part(canonical, '@', 2) as domain, count(distinct canonical)::bigint as contacts, count(distinct id)::bigint as sources
    from c group by 1""",
)
def flagship(spark, sf):
    """Addresses in the whole corpus per mail domain."""
    found = X.extract_emails(corpus(spark, sf), "id", "text")
    named = found.select("id", A.canonical(F.col("email")).alias("canonical")).withColumn(
        "domain", A.part(F.col("canonical"), 1)
    )
    return named.groupBy("domain").agg(
        F.count_distinct("canonical").alias("contacts"), F.count_distinct("id").alias("sources")
    )


@query(
    "x3_page_text",
    f"""select page_id, {D.collapse(D.strip("regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)"))} as title,
    md5({D.strip_markup('html')}) as text_md5 from pages""",
)
def x3(spark, sf):
    return X.page_text(_pages(spark, sf)).select("page_id", "title", F.md5("body_text").alias("text_md5"))


_TITLE = D.collapse(D.strip("regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)"))
_RECORDS = f"""src as (select page_id, url, html, {D.deobfuscate('html')} as doc from pages where contains(html, '@')),
 txt as (select *, {D.strip_markup('doc')} as body from src),
 tiers as (select *, list_distinct(list_transform(list_filter(regexp_extract_all(doc,
   {D.lit('(?i)href=["' + chr(39) + ']mailto:([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+' + chr(92) + '.[a-zA-Z]{2,})[^"' + chr(39) + ']*["' + chr(39) + ']')}, 1),
   lambda e: {D.valid_tld('e')}), lambda e: lower(e))) as m,
   {D.valid_emails(D.deobfuscate('body'))} as v, {D.valid_emails(D.deobfuscate('doc'))} as a from txt),
 hits as (select page_id, url, html, doc, body, m, v, unnest(list_distinct(list_concat(list_concat(m, v), a))) as email from tiers),
 seen as (select *, list_contains(v, email) as in_text, list_contains(m, email) as in_mailto,
   case when list_contains(v, email) then {D.snippet('body', 'email', 50)} else '' end as near,
   {D.strip(D.collapse(D.sub(D.sub(D.snippet('doc', 'email', 40), '<[^>]+>', ' '), '&quot;', '"', 'gi')))} as raw from hits),
 recs as (select *, case when in_text and (not in_mailto or near <> '') then 'text' when in_mailto then 'mailto' else 'metadata' end as context_type from seen),
 records as (select *, case context_type when 'text' then near when 'mailto' then 'mailto link on page'
   else case when raw = '' then 'Embedded in page metadata/scripts' else raw end end as context from recs)"""


@query(
    "x4_extract_contact_records",
    f"""with {_RECORDS} select page_id, email, split_part(email, '@', 2) as domain,
    case when {D.role('email')} then 'role' else 'personal' end as type,
    coalesce(case when not {D.role('email')} then {D.infer_name('email')} end, '') as name,
    context_type, context as context_snippet, url as source_url, {_TITLE} as page_title,
    coalesce(list_extract(list_filter({D.phones('html')}, lambda p: contains(context, p)), 1), list_extract({D.phones('html')}, 1), '') as phone,
    coalesce({D.title('context')}, {D.title('html')}, '') as job_title,
    'unverified' as mx_status, 'http' as extraction_method from records""",
)
def x4(spark, sf):
    recs = X.extract_contact_records(_pages(spark, sf), discovered_at=F.lit("2024-01-01"))
    return recs.select(
        "page_id", "email", "domain", "type", F.coalesce("name", F.lit("")).alias("name"), "context_type", "context_snippet",
        "source_url", "page_title", F.coalesce("phone", F.lit("")).alias("phone"),
        F.coalesce("job_title", F.lit("")).alias("job_title"), "mx_status", "extraction_method",
    )


@query(
    "x5_context_snippets",
    f"""with {_CORPUS}, {_FOUND} select f.id, f.email, {D.snippet('c.text', 'f.email', 50)} as snippet
    from found f join corpus c on f.id = c.id""",
)
def x5(spark, sf):
    texts = corpus(spark, sf)
    found = X.extract_emails(texts, "id", "text")
    return X.context_snippets(found.join(texts, "id"), "text", "email").select("id", "email", "snippet")


@query(
    "x6_extract_phones",
    f"""with {_CORPUS} select distinct id, unnest({D.phones('text')}) as phone from corpus""",
)
def x6(spark, sf):
    return X.extract_phones(corpus(spark, sf), "id", "text").select("id", "phone")


_PROFILE_HTML = """'<p>' || case when contact_id % 3 = 0 then '<a href="https://www.LinkedIn.com/in/p-' || contact_id || '?x=1">in</a>' else '' end
 || case when contact_id % 4 = 0 then ' https://x.com/user_' || contact_id || ' https://x.com/other' else '' end
 || case when contact_id % 5 = 0 then ' http://github.com/dev.' || contact_id || '/repo' else '' end || '</p>'"""


@query(
    "x7_extract_socials",
    f"""with {S.contacts_cte('orders')}, h as (select contact_id, {_PROFILE_HTML} as html from contacts) select contact_id,
    regexp_extract(html, '(?i)https?://(?:www\\.)?linkedin\\.com/(?:in|company)/[a-zA-Z0-9._%-]+') as linkedin,
    regexp_extract(html, '(?i)https?://(?:www\\.)?(?:twitter\\.com|x\\.com)/[a-zA-Z0-9_]+') as twitter,
    regexp_extract(html, '(?i)https?://(?:www\\.)?github\\.com/[a-zA-Z0-9._%-]+') as github from h""",
)
def x7(spark, sf):
    html = S.contacts(spark, sf, "orders").selectExpr("contact_id", f"{_PROFILE_HTML} as html")
    out = X.extract_socials(html)
    return out.select(
        "contact_id", *[F.coalesce(f"socials.{n}", F.lit("")).alias(n) for n in ("linkedin", "twitter", "github")]
    )


_TITLE_TEXT = """AT(ARR('Alex is the chief executive officer of Acme','our VP and Head of Growth','https://x.com/ceo <b>Senior Data Engineer</b>',
 'Vice President of Sales, Founder','ceo and developer','Supervisor','Directory of people','Director of Ops','Tech Lead',
 'account executive'), cast(contact_id % 10 as int) + 1) || ' ' || cast(contact_id as STR)"""


@query(
    "x8_detect_job_titles",
    f"""with {S.contacts_cte('orders')}, t as (select contact_id, {S.duck_sql(_TITLE_TEXT)} as text from contacts)
    select contact_id, coalesce({D.title('text')}, '') as job_title from t""",
)
def x8(spark, sf):
    texts = S.contacts(spark, sf, "orders").selectExpr("contact_id", f"{S.spark_sql(_TITLE_TEXT)} as text")
    return X.detect_job_titles(texts, "text").select("contact_id", F.coalesce("job_title", F.lit("")).alias("job_title"))


@query(
    "x9_infer_names",
    f"""with {S.contacts_cte('orders')} select contact_id, coalesce(case when not {D.role('email')} then {D.infer_name('email')} end, '') as name,
    {D.display_name('email')} as display_name from contacts""",
)
def x9(spark, sf):
    return X.infer_names(S.contacts(spark, sf, "orders")).select(
        "contact_id", F.coalesce("name", F.lit("")).alias("name"), "display_name"
    )


@query(
    "x10_classify_addresses",
    f"""with {S.contacts_cte('orders')}, c as (select *, lower(split_part(email, '@', 2)) as domain, {D.role('email')} as is_role from contacts)
    select contact_id, case when is_role then 'role' else 'personal' end as type,
    (domain in {D.in_list(D.K.DISPOSABLE_DOMAINS)})::int as is_disposable,
    case when is_role then 'General' when domain in {D.in_list(D.K.PERSONAL_PROVIDERS)} then 'Personal' else 'Business' end as email_category from c""",
)
def x10(spark, sf):
    out = X.classify_addresses(S.contacts(spark, sf, "orders"))
    return out.select("contact_id", "type", F.col("is_disposable").cast("int").alias("is_disposable"), "email_category")


_BATCH = """select url, page_id as ord from pages union all
 select case page_id % 4 when 0 then 'ftp://files.example.com/' || page_id when 1 then '' when 2 then 'http://10.0.0.1/' || page_id
 else 'https://missing.example.com/' || page_id end, page_id + 1000000 from pages union all select url, page_id + 2000000 from pages"""


@query(
    "x11_scrape_batch",
    f"""with {_RECORDS}, asked as ({_BATCH}), n as (select url, count(*) as n from records group by url)
    select ord, asked.url, (ord < 1000000 or ord >= 2000000)::int as success, case when ord < 1000000 or ord >= 2000000 then coalesce(n.n, 0) else 0 end::bigint as email_count,
    case when ord < 1000000 or ord >= 2000000 then '' when ord % 4 = 0 then 'Invalid protocol. Only http: and https: are allowed.'
     when ord % 4 = 1 then 'Empty or invalid URL string' when ord % 4 = 2 then 'URL rejected: restricted_ip' else 'Page not in snapshot' end as error
    from asked left join n on asked.url = n.url""",
)
def x11(spark, sf):
    spark.read.parquet(f"{sf}/pages.parquet").createOrReplaceTempView("pages")
    outcome, _ = P.scrape_batch(_pages(spark, sf), spark.sql(_BATCH), discovered_at=F.lit("x"))
    return outcome.select(
        "ord", "url", F.col("success").cast("int").alias("success"), F.col("email_count").cast("bigint").alias("email_count"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query(
    "x12_unique_contacts",
    f"""with {S.rich_cte('orders')}, r as (select *, row_number() over (partition by email order by ord desc) as rn from rich)
    select email, contact_id, page_title from r where rn = 1""",
)
def x12(spark, sf):
    return X.unique_contacts(S.rich_contacts(spark, sf, "orders"), [-F.col("ord")]).select(
        "email", "contact_id", "page_title"
    )


_CLEAN = D.collapse(D.sub(D.strip("context"), "<[^>]+>", " "))


@query(
    "x13_extraction_post_process",
    f"""with {_RECORDS}, cut as (select page_id, email, {_CLEAN} as c from records)
    select page_id, email, case when length(c) > 40 then {D.strip('substring(c, 1, 40)')} || '...' else c end as context_snippet,
    (email like '%@mail1.example.com')::int as is_suppressed, case when email like '%@mail1.example.com' then 'BOUNCE' else '' end as suppression_reason from cut""",
)
def x13(spark, sf):
    recs = X.extract_contact_records(_pages(spark, sf), discovered_at=F.lit("x"))
    # The list holds one domain, derived from the extracted addresses themselves.
    blocked = recs.where(F.col("domain") == "mail1.example.com").select(
        F.lit("1").alias("id"), F.lit("domain").alias("type"), F.col("domain").alias("value"), F.lit("BOUNCE").alias("reason")
    ).distinct()
    out = P.extraction_post_process(recs, blocked, max_chars=40)
    return out.select(
        "page_id", "email", "context_snippet", F.col("is_suppressed").cast("int").alias("is_suppressed"),
        F.coalesce("suppression_reason", F.lit("")).alias("suppression_reason"),
    )


@query(
    "x6_phones_strict",
    f"""with {_CORPUS} select distinct id, unnest(list_filter({D.phones('text')}, lambda p: list_contains(list_transform(
      regexp_extract_all(text, '[+(]?\\d[\\d\\-. ()]*'), lambda w: {D.strip('w')}), p))) as phone from corpus""",
)
def x6_strict(spark, sf):
    return X.extract_phones(corpus(spark, sf), "id", "text", strict=True).select("id", "phone")
