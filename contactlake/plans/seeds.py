"""Contact-shaped tables derived from the given tables, in Spark and DuckDB SQL.

One template serves both engines, so the rows are identical and grow with the
source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def spark_sql(t: str) -> str:
    return t.replace("ARR(", "array(").replace("AT(", "element_at(").replace("STR", "string")


def duck_sql(t: str) -> str:
    return t.replace("ARR(", "list_value(").replace("AT(", "list_extract(").replace("STR", "varchar")


KEYS = {
    "customer": ("customer", "c_custkey"),
    "orders": ("orders", "o_orderkey"),
    "lineitem": ("lineitem", "l_orderkey * 8 + l_linenumber"),
}

EMAIL = """AT(ARR('info','support',concat('john.doe',cast(k as STR)),concat('j.o.h.n+promo',cast(k as STR)),
  'sales-eu',concat('u',cast(k as STR),'98716281'),'qzxkjfw98721plm','.lead','a..b','spamtrap',
  concat('marcus_aurelius_',cast(k as STR)),'alexsmith'), cast(k%12 as int)+1)
 || '@' ||
 AT(ARR('gmail.com','googlemail.com','gmial.com','hotmial.com','mailinator.com','example.com','corp.internal',
  'acme-demo.com','techcorp.io','-bad-.com','192.168.0.1','a.b.c.d.e.com','xn--bcher-kva.com','company.notatld',
  'protonmai.com'), cast((k*7)%15 as int)+1)"""

# Every other address lives on a domain of its own key, so domains grow with the table.
MIXED_EMAIL = f"case when k % 2 = 0 then {EMAIL} else concat('User', cast(k as STR), '@corp', cast(k % 997 as STR), '.com') end"

RICH = """contact_id, email, contact_id as ord, lower(split_part(email,'@',2)) as domain,
 case when contact_id%12 in (0,1,4) then 'role' else 'personal' end as type,
 AT(ARR('deliverable','undeliverable','disposable','risky','pending','unverified'), cast(contact_id%6 as int)+1) as mx_status,
 case when contact_id%7=0 then true when contact_id%7=1 then null else false end as is_catch_all,
 case when contact_id%12=2 then concat('John Doe', cast(contact_id as STR)) when contact_id%4=0 then 'Dana Reyes'
  when contact_id%4=1 then null else '' end as name,
 case when contact_id%4=0 then 'Director of Sales' when contact_id%4=2 then '=SUM(1)' else null end as job_title,
 case when contact_id%3=0 then concat('+1 (555) 010-', cast(1000+contact_id%9000 as STR)) else null end as phone,
 case when contact_id%5=0 then concat('https://www.linkedin.com/in/p', cast(contact_id as STR)) else null end as linkedin,
 case when contact_id%10=1 then concat('https://x.com/p', cast(contact_id as STR)) else null end as twitter,
 AT(ARR('https://acme-demo.com/contact','https://acme-demo.com/Team/','https://acme-demo.com/about-us',
  'https://acme-demo.com/#footer',concat('https://acme-demo.com/p', cast(contact_id as STR)),'ftp://x/','',null),
  cast(contact_id%8 as int)+1) as source_url,
 concat('Page ', cast(contact_id%50 as STR)) as page_title,
 concat('Write to ', email, ' or call "desk" ', cast(contact_id as STR)) as context_snippet,
 case when contact_id%6<>5 then concat('Company ', cast(contact_id%40 as STR)) else null end as company,
 case when contact_id%9=0 then null else cast(contact_id%20 as STR) end as job_id,
 case when contact_id%3=0 then 'Business' when contact_id%3=1 then 'Personal' else null end as email_category"""


def _keys(spark: SparkSession, sf: str, source: str) -> DataFrame:
    table, key = KEYS[source]
    return spark.read.parquet(f"{sf}/{table}.parquet").selectExpr(f"{key} as k")


def contacts(spark: SparkSession, sf: str, source: str = "customer", email: str = EMAIL) -> DataFrame:
    """contact_id, email"""
    return _keys(spark, sf, source).selectExpr("k as contact_id", f"{spark_sql(email)} as email")


def rich_contacts(spark: SparkSession, sf: str, source: str = "customer", email: str = EMAIL) -> DataFrame:
    """Contacts with every exported column."""
    contacts(spark, sf, source, email).createOrReplaceTempView("__contacts_seed")
    rich = spark.sql(f"select {spark_sql(RICH)} from __contacts_seed")
    return (
        rich.withColumn("socials", F.struct("linkedin", "twitter", F.lit(None).cast("string").alias("github")))
        .withColumn("provider", F.lit(None).cast("string"))
        .withColumn("depth", F.lit(0))
        .withColumn("mx_records", F.array().cast("array<string>"))
        .withColumn("discovered_at", F.lit("2024-01-01T00:00:00.000Z"))
    )


def contacts_cte(source: str = "customer", email: str = EMAIL) -> str:
    table, key = KEYS[source]
    return f"contacts as (select k as contact_id, {duck_sql(email)} as email from (select {key} as k from {table}) t)"


def rich_cte(source: str = "customer", email: str = EMAIL) -> str:
    return f"{contacts_cte(source, email)}, rich as (select {duck_sql(RICH)} from contacts)"


# DNS answers: a few well-known shapes, and one pattern per corporate domain of the keys.
_DNS_FIXED = """select 'gmail.com' as domain, 15 as rr_type, '5 gmail-smtp-in.l.google.com.' as data
 union all select 'googlemail.com', 15, '10 alt1.gmail-smtp-in.l.google.com.'
 union all select 'acme-demo.com', 15, '20 mx2.pphosted.com.'
 union all select 'acme-demo.com', 15, '10 mx1.pphosted.com.'
 union all select 'techcorp.io', 1, '203.0.113.7'
 union all select 'mx1.pphosted.com', 1, '198.51.100.9'
 union all select 'protonmai.com', 15, '0 .'
 union all select 'a.b.c.d.e.com', 15, 'x mail.zoho.com.'"""

def dns_sql(table: str) -> str:
    """DNS snapshot over a relation ``table(k)``; same text for both engines."""
    corp = f"(select distinct k % 997 as c from {table}) q"
    name = "concat('corp', cast(c as STR), '.com')"
    return f"""{_DNS_FIXED}
 union all select {name}, 15, concat('10 mx.corp', cast(c as STR), '.com.') from {corp} where c % 7 = 0
 union all select {name}, 15, '10 alt1.aspmx.l.google.com.' from {corp} where c % 7 = 1
 union all select {name}, 15, '5 aspmx.l.google.com.' from {corp} where c % 7 = 1
 union all select {name}, 15, '0 .' from {corp} where c % 7 = 2
 union all select {name}, 1, concat('203.0.113.', cast(c % 250 as STR)) from {corp} where c % 7 = 3
 union all select {name}, 15, '0 mail.protection.outlook.com.' from {corp} where c % 7 = 4
 union all select concat('mx.corp', cast(c as STR), '.com'), 1, concat('198.18.0.', cast(c % 250 as STR)) from {corp} where c % 7 = 0"""


def dns(spark: SparkSession, sf: str, source: str = "customer") -> DataFrame:
    _keys(spark, sf, source).createOrReplaceTempView("__dns_keys")
    return spark.sql(spark_sql(dns_sql("__dns_keys")))


def dns_cte(source: str = "customer") -> str:
    table, key = KEYS[source]
    return f"keys as (select {key} as k from {table}), dns as ({duck_sql(dns_sql('keys'))})"


SUPPRESSION = """select concat('e', cast(contact_id as STR)) as id, 'email' as type, concat(' ', upper(email)) as value, 'UNSUBSCRIBE' as reason from contacts where contact_id % 50 = 0
 union all select concat('s', cast(contact_id as STR)), 'sha256', SHA(lower(email)), 'LEGAL_REQUEST' from contacts where contact_id % 50 = 1
 union all select concat('m', cast(contact_id as STR)), 'md5', md5(lower(email)), 'COMPLAINT' from contacts where contact_id % 50 = 2
 union all select 'd1', 'domain', '@TechCorp.io', 'DO_NOT_CONTACT'
 union all select concat('d', cast(contact_id as STR)), 'domain', concat('corp', cast(contact_id % 997 as STR), '.com'), 'BOUNCE' from contacts where contact_id % 211 = 5"""


def suppression(spark: SparkSession, sf: str, source: str = "customer", email: str = EMAIL) -> DataFrame:
    contacts(spark, sf, source, email).createOrReplaceTempView("contacts")
    text = spark_sql(SUPPRESSION).replace("SHA(lower(email))", "sha2(lower(email), 256)")
    return spark.sql(text)


def suppression_cte() -> str:
    """Needs ``contacts``."""
    return f"suppression as ({duck_sql(SUPPRESSION).replace('SHA(', 'sha256(')})"


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl jobs from the orders: owner, status, start and end."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.selectExpr(
        "o_orderkey as job_id", "cast(o_custkey as string) as owner",
        "case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'running' end as status",
        "cast(o_orderdate as timestamp) + make_interval(0,0,0,0,0,cast(o_orderkey % 7 as int)) as started_at",
        "case when o_orderkey % 11 = 0 then null else cast(o_orderdate as timestamp) + make_interval(0,0,0,0,0,cast(o_orderkey % 7 + o_orderkey % 30 as int)) end as ended_at",
        "cast(o_orderkey % 3 as int) as retry_count", "1 as max_retries", "o_orderkey % 5 = 0 as is_browser",
    )


JOBS_CTE = """jobs as (select o_orderkey as job_id, cast(o_custkey as varchar) as owner,
 case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'running' end as status,
 o_orderdate + to_minutes(cast(o_orderkey % 7 as int)) as started_at,
 case when o_orderkey % 11 = 0 then null else o_orderdate + to_minutes(cast(o_orderkey % 7 + o_orderkey % 30 as int)) end as ended_at,
 cast(o_orderkey % 3 as int) as retry_count, 1 as max_retries, o_orderkey % 5 = 0 as is_browser from orders)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl events from the event table: job_id, event_id, ts, event."""
    return crawl_events(spark.read.parquet(f"{sf}/events.parquet"))


def crawl_events(raw: DataFrame) -> DataFrame:
    """Also for streams: maps the event types onto crawl events."""
    return raw.selectExpr(
        "user_id as job_id", "event_id", "cast(ts as timestamp) as ts",
        "case event_type when 'view' then 'progress' when 'click' then 'record' when 'signup' then 'started' "
        "when 'purchase' then 'done' else 'crawler_error' end as event",
    )


EVENTS_CTE = """ev as (select user_id as job_id, event_id, ts, case event_type when 'view' then 'progress' when 'click' then 'record'
 when 'signup' then 'started' when 'purchase' then 'done' else 'crawler_error' end as event from events)"""
