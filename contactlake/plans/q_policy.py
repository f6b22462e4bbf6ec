"""Registered policy, link and graph queries."""

from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.operators import graph as G
from contactlake.operators import links as L
from contactlake.operators import policy as P
from contactlake.operators.extraction import extract_contact_records
from contactlake.plans import ducksql as D
from contactlake.plans import seeds as S
from contactlake.plans.q_extract import _RECORDS
from contactlake.plans.registry import query

_PATHS = """contact_id, AT(ARR('/wp-admin/settings.php','/login','/.git/config','/about-us','/Admin','/checkout/step','/user/password/x','/adminx',
 '/internal','/shop/cart','/payment?x=/a','/.well-known/security.txt'), cast(contact_id % 12 as int) + 1) as p"""
_URLS = "case when contact_id % 17 = 0 then 'not a url' else concat('https://site', cast(contact_id % 31 as STR), '.com', p) end"


def _urls(spark, sf, source="orders"):
    S.contacts(spark, sf, source).createOrReplaceTempView("contacts")
    return spark.sql(S.spark_sql(f"select contact_id, {_URLS} as url from (select {_PATHS} from contacts) t"))


_LOW = "lower(regexp_extract(p, '^[^?]*'))"


@query(
    "c13_restricted_paths",
    f"""with {S.contacts_cte('orders')}, p as (select {S.duck_sql(_PATHS)} from contacts) select contact_id,
    (contact_id % 17 = 0 or {' or '.join(f'regexp_matches({_LOW}, {D.lit(rx)})' for rx in K.RESTRICTED_PATHS)})::int as restricted,
    case when contact_id % 17 = 0 then 'Malformed URL path cannot be verified for compliance.'
     when {' or '.join(f'regexp_matches({_LOW}, {D.lit(rx)})' for rx in K.RESTRICTED_PATHS)}
     then 'Access to restricted/sensitive path "' || {_LOW} || '" is prohibited under platform compliance policies.' else '' end as reason from p""",
)
def c13(spark, sf):
    out = P.restricted_paths(_urls(spark, sf))
    return out.select("contact_id", F.col("restricted").cast("int").alias("restricted"), F.coalesce("reason", F.lit("")).alias("reason"))


_ROBOTS = """concat('# rules of host ', cast(h as STR), NL, 'User-agent: otherbot', NL, 'Disallow: /no-other/', NL, NL,
 case when h % 3 = 0 then concat('User-Agent: contactlake', NL, 'User-agent: second # two names', NL, 'Disallow: /wp-admin', NL, 'Disallow:', NL,
   'Disallow: /*cart', NL, 'Allow: /wp-admin/settings', NL, 'Crawl-delay: 2.5', NL) else '' end,
 case when h % 2 = 0 then concat('User-agent: *', NL, 'Disallow: /login$', NL, 'Disallow: /.git', NL, 'Crawl-delay: ', cast(h as STR), NL) else '' end)"""


def _robots(spark, sf):
    S.contacts(spark, sf, "orders").createOrReplaceTempView("contacts")
    text = S.spark_sql(_ROBOTS).replace("NL", "'\\n'")
    return spark.sql(f"select concat('site', cast(h as string), '.com') as host, {text} as content from (select distinct contact_id % 31 as h from contacts) t")


@query(
    "c14_robots_rules",
    f"""with {S.contacts_cte('orders')}, h as (select distinct contact_id % 31 as h from contacts), s as (select h, 'site' || h || '.com' as host from h),
    g as (select host, 'otherbot' as ua, 0 as delay, '' as allow, '/no-other/' as disallow from s
     union all select host, unnest(['contactlake', 'second']), 2500, '/wp-admin/settings', '/wp-admin,/*cart' from s where h % 3 = 0
     union all select host, '*', h * 1000, '', '/login$,/.git' from s where h % 2 = 0)
    select host, ua, delay::bigint as crawl_delay_ms, allow, disallow from g""",
)
def c14(spark, sf):
    out = P.robots_rules(_robots(spark, sf))
    return out.select(
        "host", "ua", F.coalesce("crawl_delay_ms", F.lit(0)).cast("bigint").alias("crawl_delay_ms"),
        F.array_join("allow", ",").alias("allow"), F.array_join("disallow", ",").alias("disallow"),
    )


@query(
    "c15_robots_allowed",
    f"""with {S.contacts_cte('orders')}, p as (select *, case when contact_id % 17 = 0 then 1 else contact_id % 31 end as h from (select {S.duck_sql(_PATHS)} from contacts) q),
    v as (select contact_id, p, h, case when h % 3 = 0 then case when starts_with(p, '/wp-admin/settings') then '' when starts_with(p, '/wp-admin') then '/wp-admin' when regexp_matches(p, '^/.*cart') then '/*cart' else '' end
      when h % 2 = 0 then case when p = '/login' then '/login$' when starts_with(p, '/.git') then '/.git' else '' end else '' end as blocked_by from p)
    select contact_id, (blocked_by = '')::int as allowed, blocked_by, (case when h % 3 = 0 then 2500 when h % 2 = 0 then h * 1000 else 0 end)::bigint as crawl_delay_ms from v""",
)
def c15(spark, sf):
    out = P.robots_allowed(_urls(spark, sf), P.robots_rules(_robots(spark, sf)))
    return out.select(
        "contact_id", F.col("allowed").cast("int").alias("allowed"), F.coalesce("blocked_by", F.lit("")).alias("blocked_by"),
        F.coalesce("crawl_delay_ms", F.lit(0)).cast("bigint").alias("crawl_delay_ms"),
    )


@query(
    "c15_robots_prefix",
    f"""with {S.contacts_cte('orders')}, p as (select *, case when contact_id % 17 = 0 then 1 else contact_id % 31 end as h from (select {S.duck_sql(_PATHS)} from contacts) q)
    select contact_id, (h % 2 = 0 and (starts_with(p, '/login$') or starts_with(p, '/.git')))::int as blocked from p""",
)
def c15_prefix(spark, sf):
    out = P.robots_prefix_blocked(_urls(spark, sf), P.robots_rules(_robots(spark, sf)))
    return out.select("contact_id", F.col("blocked").cast("int").alias("blocked"))


# One IPv4 number per key, in five spellings, and some named hosts.
_N = "contact_id, (contact_id * 2654435761) % 4294967296 as n"
_DOTTED = " || '.' || ".join(f"cast((n DIV {d}) % 256 as STR)" for d in (16777216, 65536, 256, 1))
_SAFE_URL = f"""case contact_id % 8 when 0 then 'http://' || {_DOTTED} || '/x' when 1 then 'https://' || cast(n as STR) || ':8080/'
 when 2 then 'http://0x' || HEX || '/a' when 3 then 'http://[::ffff:' || {_DOTTED} || ']/m'
 when 4 then 'http://host' || cast(contact_id as STR) || '.com/p' when 5 then 'http://user:pw@host' || cast(contact_id as STR) || '.com/'
 when 6 then 'http://sub' || cast(contact_id as STR) || '.localhost/x' else 'http://[fe80::' || cast(contact_id % 9000 as STR) || ']/' end"""


def _range(c: str) -> str:
    out = []
    for start, bits in K.RESTRICTED_CIDRS:
        a, b, c2, d = (int(x) for x in start.split("."))
        low = a * 16777216 + b * 65536 + c2 * 256 + d
        out.append(f"{c} between {low} and {low + 2 ** (32 - bits) - 1}")
    return "(" + " or ".join(out) + ")"


@query(
    "c16_url_safety",
    f"""with {S.contacts_cte('orders')}, q as (select {_N} from contacts),
    n as (select contact_id, n as ip, {S.duck_sql(_SAFE_URL).replace('DIV', '//').replace('HEX', "format('{:x}', n)")} as url from q)
    select contact_id, url, case when contact_id % 8 < 4 then case when ip between 2130706432 and 2147483647 then 'loopback'
      when ip between 2851995648 and 2852061183 or ip = 1684300488 then 'metadata_ip' when {_range('ip')} then 'restricted_ip' else '' end
     when contact_id % 8 = 4 then '' when contact_id % 8 = 5 then 'url_credentials' when contact_id % 8 = 6 then 'localhost' else 'restricted_ip' end as unsafe_reason from n""",
)
def c16(spark, sf):
    numbered = S.contacts(spark, sf, "orders").selectExpr(*_N.split(", "))
    urls = numbered.selectExpr("contact_id", f"{S.spark_sql(_SAFE_URL).replace('HEX', 'lower(hex(n))')} as url")
    return P.url_safety(urls).select("contact_id", "url", F.coalesce("unsafe_reason", F.lit("")).alias("unsafe_reason"))


@query(
    "c16_url_safety_resolved",
    f"""with {S.contacts_cte('orders')} select contact_id, case contact_id % 5 when 0 then 'unresolved' when 1 then 'resolves_to_restricted_ip' else '' end as unsafe_reason from contacts""",
)
def c16_resolved(spark, sf):
    c = S.contacts(spark, sf, "orders")
    urls = c.selectExpr("contact_id", "concat('https://Host', contact_id, '.com/p') as url")
    resolved = c.where("contact_id % 5 > 0").selectExpr(
        "concat('host', contact_id, '.com') as host", "case when contact_id % 5 = 1 then concat('10.0.0.', contact_id % 250) else concat('93.184.216.', contact_id % 250) end as ip"
    ).unionByName(c.where("contact_id % 5 = 1").selectExpr("concat('host', contact_id, '.com') as host", "'93.184.216.34' as ip"))
    return P.url_safety(urls, resolved).select("contact_id", F.coalesce("unsafe_reason", F.lit("")).alias("unsafe_reason"))


_NAMES = """AT(ARR('../../../etc/pa','..\\\\win\\\\sys','report?.csv','.hidden','a<b>.csv','',' leads ','con|x'), cast(contact_id % 8 as int) + 1) || case when contact_id % 8 = 5 then '' else cast(contact_id as STR) end"""


@query(
    "c17_safe_filenames",
    f"""with {S.contacts_cte('orders')}, n as (select contact_id, {S.duck_sql(_NAMES).replace(chr(92) * 2, chr(92))} as f from contacts),
    c as (select contact_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(f, '[\\x00\\r\\n\\t]', '', 'g'), '\\.{{2,}}', '.', 'g'), '[<>:"/\\\\|?*]', '_', 'g')), '^[./\\\\]+', '') as f from n)
    select contact_id, case when f = '' then 'export.csv' else f end as filename from c""",
)
def c17(spark, sf):
    names = S.contacts(spark, sf, "orders").selectExpr("contact_id", f"{S.spark_sql(_NAMES)} as filename")
    return P.safe_filenames(names).select("contact_id", "filename")


def _pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


_ENC = "url_encode(href)"
_HREF = """select page_id, url, unnest(regexp_extract_all(html, '(?i)<a[^>]+href=["\\x27]([^"\\x27]+)["\\x27]', 1)) as href from pages"""
_ORIGIN = "regexp_extract(url, '^(https?://[^/]+)', 1)"
_KEEP = "replace(replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%3A', ':'), '%27', chr(39))"


@query(
    "g1_extract_links",
    f"""with h as ({_HREF}) select distinct url as src, lower({_ORIGIN}) || {_KEEP} as dst from h where starts_with(href, '/')""",
)
def g1(spark, sf):
    return L.extract_links(_pages(spark, sf))


_LINKS = """AT(ARR('/a/./b/../c?utm_source=x&q=1#f','page.html','//CDN.Example.com/x','mailto:a@b.c','https://Other.example.org:443/','logo.png',
 '?p=2&fbclid=1','../up/','javascript:void(0)','#top'), cast(contact_id % 10 as int) + 1)"""


@query(
    "g2_normalise_urls",
    f"""with {S.contacts_cte('orders')} select contact_id, AT(ARR('https://h' || contact_id || '.com/a/c?q=1','https://h' || contact_id || '.com/d/page.html','https://cdn.example.com/x','',
    'https://other.example.org/','','https://h' || contact_id || '.com/d/e?p=2','https://h' || contact_id || '.com/up/','','https://h' || contact_id || '.com/d/e?z=0'), cast(contact_id % 10 as int) + 1) as dst from contacts""".replace("AT(", "list_extract(").replace("ARR(", "list_value("),
)
def g2(spark, sf):
    rows = S.contacts(spark, sf, "orders").selectExpr(
        "contact_id", f"{S.spark_sql(_LINKS)} as href", "concat('https://H', contact_id, '.com/d/e?z=0') as url"
    )
    return L.normalise_urls(rows).select("contact_id", F.coalesce("dst", F.lit("")).alias("dst"))


_CANON = """case contact_id % 4 when 0 then '<link rel="canonical" href="/c/' || cast(contact_id as STR) || '?gclid=5">' when 1 then '<link href="https://x.example.com/k' || cast(contact_id as STR) || '" rel="canonical"/>'
 when 2 then '<link rel="stylesheet" href="/s.css">' else '<link rel="canonical" href="https://x.example.com/p' || cast(contact_id as STR) || '">' end"""


@query(
    "g3_canonical_edges",
    f"""with {S.contacts_cte('orders')} select 'https://x.example.com/p' || contact_id as src,
    case contact_id % 4 when 0 then 'https://x.example.com/c/' || contact_id else 'https://x.example.com/k' || contact_id end as dst from contacts where contact_id % 4 < 2""",
)
def g3(spark, sf):
    pages = S.contacts(spark, sf, "orders").selectExpr("concat('https://x.example.com/p', contact_id) as url", f"{S.spark_sql(_CANON)} as html")
    return L.canonical_edges(pages)


_PRIO = """'https://h.com' || AT(ARR('/contact','/contacts','/about-us','/our_team','/Team/x','/staff.html','/blog?about=1','/get-in-touch','/peoples'), cast(contact_id % 9 as int) + 1) || '/' || cast(contact_id as STR)"""


@query(
    "g4_contact_priority",
    f"""with {S.contacts_cte('orders')}, u as (select contact_id, {S.duck_sql(_PRIO)} as url from contacts)
    select contact_id, regexp_matches(lower(regexp_extract(url, '^https://[^/]+([^?]*)', 1)), '\\b(?:contact|about|team|staff|people|support|reach|impressum|touch)\\b')::int as priority from u""",
)
def g4(spark, sf):
    urls = S.contacts(spark, sf, "orders").selectExpr("contact_id", f"{S.spark_sql(_PRIO)} as url")
    return L.contact_priority(urls).select("contact_id", F.col("priority").cast("int").alias("priority"))


_EDGES = """select a as src, b as dst from (select page_id as a, 2 * page_id + 1 as b from pages union select page_id, 2 * page_id + 2 from pages
 union select page_id, (page_id * 7 + 3) % (select count(*) from pages) from pages) e where b in (select page_id from pages)"""


def _graph(spark, sf):
    spark.read.parquet(f"{sf}/pages.parquet").select("page_id").createOrReplaceTempView("pages")
    name = lambda c: F.concat(F.lit("https://s.com/p"), F.col(c)).alias(c)
    links = spark.sql(_EDGES).select(name("src"), name("dst"))
    seeds = spark.sql("select min(page_id) as url from pages").select(name("url"))
    return seeds, links


@query(
    "g5_crawl_frontier",
    f"""with recursive e as ({_EDGES}), r(n, depth) as (select min(page_id), 0 from pages union select e.dst, r.depth + 1 from r join e on r.n = e.src where r.depth < 4),
    d as (select n, min(depth) as depth from r group by n), k as (select *, row_number() over (order by (depth = 0) desc, depth, 'https://s.com/p' || n) as visit_rank from d)
    select 'https://s.com/p' || n as url, depth::int as depth, visit_rank::int as visit_rank from k where visit_rank <= 80""",
)
def g5(spark, sf):
    seeds, links = _graph(spark, sf)
    return G.crawl_frontier(seeds, links, max_depth=4, max_pages=80).select("url", "depth", "visit_rank")


@query(
    "g5_frontier_robots_canonical",
    f"""with recursive e as ({_EDGES}), ok as (select src, dst from e where dst % 5 <> 3),
    r(n, depth) as (select min(page_id), 0 from pages union
      select t.dst, t.d from (select ok.dst, r.depth + 1 as d from r join ok on r.n = ok.src where r.depth < (select ceil(4 * log2(count(*) + 2)) from pages)
        union all select (r.n + 1)::bigint, r.depth from r where r.n % 10 = 0 and (r.n + 1) in (select page_id from pages) and (r.n + 1) % 5 <> 3) t)
    select 'https://s.com/p' || n as url, min(depth)::int as depth from r group by n""",
)
def g5_policy(spark, sf):
    seeds, links = _graph(spark, sf)
    ids = spark.sql("select page_id from pages")
    named = ids.selectExpr("concat('https://s.com/p', page_id) as url", "page_id % 5 <> 3 as allowed")
    canon = spark.sql("select concat('https://s.com/p', page_id) as src, concat('https://s.com/p', page_id + 1) as dst from pages where page_id % 10 = 0 and page_id + 1 in (select page_id from pages)")
    return G.crawl_frontier(seeds, links, max_depth=None, max_pages=None, allowed=named, canonical=canon).select("url", "depth")


@query(
    "g6_site_contacts",
    f"""with recursive e as ({_EDGES}), r(n, depth) as (select min(page_id), 0 from pages union select e.dst, r.depth + 1 from r join e on r.n = e.src where r.depth < (select ceil(log2(count(*) + 2)) from pages)),
    d as (select n, min(depth) as depth from r group by n), k as (select *, row_number() over (order by (depth = 0) desc, depth, 'https://s.com/p' || n) as vr from d),
    {_RECORDS}, j as (select records.*, k.depth, k.vr from records join k on records.page_id = k.n)
    select 's.com' as site, email, arg_min(page_id, vr) as page_id, arg_min(depth, vr)::int as depth from j group by email""",
)
def g6(spark, sf):
    """Contacts of the pages that a crawl over the page ids reaches."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("url", F.concat(F.lit("https://s.com/p"), "page_id"))
    seeds, links = _graph(spark, sf)
    front = G.crawl_frontier(seeds, links, max_depth=None)
    records = extract_contact_records(pages, discovered_at=F.lit("x"))
    return G.site_contacts(front, records).select("site", "email", "page_id", "depth")


_LOGSQL = """select event_id, user_id as job_id, case when event_type <> 'error' then 200 else list_extract([403,404,429,500,503,408], (event_id % 6)::int + 1) end as status,
 case when event_id % 7 = 0 then '30' when event_id % 7 = 1 then 'Wed, 21 Oct 2026 07:28:00 GMT' when event_id % 7 = 2 then 'soon' else null end as retry_after, (event_id % 5)::int as attempt from events"""


def fetch_log(spark, sf):
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("events")
    text = _LOGSQL.replace("list_extract([403,404,429,500,503,408], (event_id % 6)::int + 1)", "element_at(array(403,404,429,500,503,408), cast(event_id % 6 as int) + 1)").replace("(event_id % 5)::int", "cast(event_id % 5 as int)")
    return spark.sql(text)


_CLASS = """c as (select *, case when status = 200 then 'SUCCESS' when status = 403 then 'ACCESS_RESTRICTED' when status = 404 then 'NOT_FOUND'
 when status in (429, 503) then 'RATE_LIMITED' else 'TRANSIENT_SERVER_ERROR' end as category from log),
 c2 as (select *, category in ('RATE_LIMITED', 'TRANSIENT_SERVER_ERROR') as retryable from c),
 c3 as (select *, case when retryable and event_id % 7 = 0 then 30000 when retryable and event_id % 7 = 1 then epoch_ms(timestamp '2026-10-21 07:28:00') - epoch_ms(timestamp '2026-10-21 07:27:50') end as ra from c2)"""


@query(
    "g7_classify_fetch_log",
    f"""with log as ({_LOGSQL}), {_CLASS} select event_id, category, retryable::int as retryable, coalesce(ra, -1)::bigint as retry_after_ms,
    case when retryable then coalesce(ra, least(10000, 500 * power(2, attempt))::bigint) else -1 end::bigint as wait_ms,
    case status when 200 then 'Request succeeded' when 403 then 'Target website explicitly denied access (HTTP 403 Forbidden)' when 404 then 'Page not found (HTTP 404)'
     when 429 then 'Target site rate-limit encountered (HTTP 429 Too Many Requests)' when 503 then 'Target server is temporarily unavailable or overloaded (HTTP 503)'
     else 'Transient server error encountered (HTTP ' || status || ')' end as reason from c3""",
)
def g7(spark, sf):
    out = P.classify_fetch_log(fetch_log(spark, sf), now=F.lit("2026-10-21 07:27:50").cast("timestamp"))
    return out.select(
        "event_id", "category", F.col("retryable").cast("int").alias("retryable"), F.coalesce("retry_after_ms", F.lit(-1)).cast("bigint").alias("retry_after_ms"),
        F.coalesce("wait_ms", F.lit(-1)).cast("bigint").alias("wait_ms"), "reason",
    )


@query(
    "g8_crawl_report",
    f"""with log as ({_LOGSQL}), {_CLASS}, {S.rich_cte('orders')}, pg as (select job_id, count(*) as v, count(*) filter (where category <> 'SUCCESS') as f, sum(attempt) as t,
    bool_or(category = 'ACCESS_RESTRICTED') as refused from c2 group by 1), ct as (select (contact_id % 150) as job_id, count(distinct email) as e, count(distinct domain) as d,
    count(distinct email) filter (where type = 'role') as rl, count(distinct email) filter (where type = 'personal') as ps from rich group by 1)
    select pg.job_id, v::bigint as pages_visited, f::bigint as pages_failed, t::bigint as retries, coalesce(e, 0)::bigint as unique_emails, coalesce(d, 0)::bigint as unique_domains,
    coalesce(rl, 0)::bigint as role_count, coalesce(ps, 0)::bigint as personal_count, case when refused then 'Target website explicitly denied access (HTTP 403 Forbidden)' else '' end as access_restricted_reason
    from pg left join ct on pg.job_id = ct.job_id""",
)
def g8(spark, sf):
    log = P.classify_fetch_log(fetch_log(spark, sf)).withColumn("seq", F.col("event_id"))
    records = S.rich_contacts(spark, sf, "orders").withColumn("job_id", F.col("contact_id") % 150)
    return G.crawl_report(log, records).drop("pages_skipped").withColumn(
        "access_restricted_reason", F.coalesce("access_restricted_reason", F.lit(""))
    )


_ARRIVALS = "select user_id % 7 as host, event_id as url, epoch_ms(ts) // 100000 * 100 as arrival_ms from events"


@query(
    "g9_polite_schedule",
    f"""with a as ({_ARRIVALS}), n as (select *, row_number() over (partition by host order by arrival_ms, url) as slot from a)
    select host, url, slot::bigint as slot, (max(arrival_ms - slot * 400) over (partition by host order by arrival_ms, url rows unbounded preceding) + slot * 400)::bigint as start_ms from n""",
)
def g9(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    urls = ev.selectExpr("user_id % 7 as host", "event_id as url", "cast(floor(unix_millis(ts) / 100000) * 100 as bigint) as arrival_ms")
    return P.polite_schedule(urls, delay_ms=400).select("host", "url", "slot", "start_ms")
