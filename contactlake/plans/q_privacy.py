"""Registered suppression, redaction and retention queries."""

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from contactlake.operators import privacy as P
from contactlake.operators import stored
from contactlake.operators import suppression as C
from contactlake.plans import ducksql as D
from contactlake.plans import seeds as S
from contactlake.plans.registry import query
from contactlake.session import shared_dir

_BASE = f"{S.contacts_cte('orders', S.MIXED_EMAIL)}, {S.suppression_cte()}"
_MATCH = f"""{_BASE},
 sup as (select *, case when type = 'domain' then regexp_replace(lower(trim(value)), '^@', '') else lower(trim(value)) end as k from suppression),
 hits as (select c.contact_id, 0 as rank, 'email' as kind, s.reason, s.value as v from contacts c join sup s on s.type = 'email' and s.k = lower(c.email)
  union all select c.contact_id, 1, 'domain', s.reason, s.value from contacts c join sup s on s.type = 'domain' and s.k = split_part(lower(c.email), '@', 2)
  union all select c.contact_id, 2, 'sha256', s.reason, s.k from contacts c join sup s on s.type in ('sha256', 'md5') and s.k = sha256(lower(c.email))
  union all select c.contact_id, 3, 'md5', s.reason, s.k from contacts c join sup s on s.type in ('sha256', 'md5') and s.k = md5(lower(c.email))),
 best as (select contact_id, min(rank) as rank, arg_min(kind, rank) as kind from hits group by 1)"""


def _pair(spark, sf):
    entries = S.suppression(spark, sf, "orders", S.MIXED_EMAIL)
    return S.contacts(spark, sf, "orders", S.MIXED_EMAIL), entries


@query(
    "c1_check_suppression",
    f"""with {_MATCH} select c.contact_id, (b.kind is not null)::int as is_suppressed, coalesce(b.kind, '') as matched_type,
    coalesce(case b.kind when 'email' then 'UNSUBSCRIBE' when 'sha256' then 'LEGAL_REQUEST' when 'md5' then 'COMPLAINT' when 'domain' then
      case when c.email ilike '%techcorp.io' then 'DO_NOT_CONTACT' else 'BOUNCE' end end, '') as suppression_reason
    from contacts c left join best b on c.contact_id = b.contact_id""",
)
def c1(spark, sf):
    contacts, entries = _pair(spark, sf)
    out = C.check_suppression(contacts, entries)
    return out.select(
        "contact_id", F.col("is_suppressed").cast("int").alias("is_suppressed"), F.coalesce("matched_type", F.lit("")).alias("matched_type"),
        F.coalesce("suppression_reason", F.lit("")).alias("suppression_reason"),
    )


@query("c2_filter_prefiltered", f"with {_MATCH} select contact_id, email from contacts where contact_id not in (select contact_id from hits)")
def c2_prefiltered(spark, sf):
    return C.filter_suppressed(*_pair(spark, sf), prefilter=True).select("contact_id", "email")


@query("c2_filter_suppressed", f"with {_MATCH} select contact_id, email from contacts where contact_id not in (select contact_id from hits)")
def c2(spark, sf):
    return C.filter_suppressed(*_pair(spark, sf))


_INCOMING = """select concat('n', cast(contact_id as STR)) as id, case contact_id % 3 when 0 then 'email' when 1 then 'domain' else 'sha256' end as type,
 case contact_id % 3 when 0 then concat(upper(email), ' ') when 1 then concat('@corp', cast(contact_id % 97 as STR), '.com') else SHA(lower(email)) end as value,
 case contact_id % 4 when 0 then 'dnc' when 1 then 'legal' when 2 then null else 'bounce' end as reason, contact_id as ord from contacts"""
_SPACE = "case when type in ('sha256', 'md5') then 'hash' else type end"
_KEY = "case when type = 'domain' then regexp_replace(lower(trim(value)), '^@', '') else lower(trim(value)) end"
_MERGE = f"""{_BASE}, inc as ({S.duck_sql(_INCOMING).replace('SHA(', 'sha256(')}), inc2 as (select *, {_SPACE} as sp, {_KEY} as k from inc),
 uniq as (select *, row_number() over (partition by sp, k order by ord) as rn from inc2),
 added as (select * from uniq where rn = 1 and (sp, k) not in (select {_SPACE}, {_KEY} from suppression))"""


def _merge_inputs(spark, sf):
    contacts, entries = _pair(spark, sf)
    contacts.createOrReplaceTempView("contacts")
    incoming = spark.sql(S.spark_sql(_INCOMING).replace("SHA(lower(email))", "sha2(lower(email), 256)"))
    return entries, incoming


@query(
    "c3_merge_suppression",
    f"""with {_MERGE} select type, k as value, case when reason = 'dnc' then 'DO_NOT_CONTACT' when reason = 'legal' then 'LEGAL_REQUEST' when reason is null then 'MANUAL' else upper(reason) end as reason from added""",
)
def c3(spark, sf):
    merged = C.merge_suppression(*_merge_inputs(spark, sf))
    return merged.where("is_new").select("type", "value", "reason")


@query(
    "c3_merge_counts",
    f"with {_MERGE} select (select count(*) from added)::bigint as added, ((select count(*) from inc) - (select count(*) from added))::bigint as existing",
)
def c3_counts(spark, sf):
    return C.merge_counts(*_merge_inputs(spark, sf))


@query(
    "c4_suppression_view",
    f"""with {_BASE}, o as (select *, case when length(id) % 3 = 0 then 'u1' when length(id) % 3 = 1 then 'u2' end as added_by from suppression)
    select id, type from o where (added_by is null or added_by = 'u1') and not (id like 'e%' and coalesce(added_by, 'u1') = 'u1')""",
)
def c4(spark, sf):
    _, entries = _pair(spark, sf)
    owned = entries.withColumn("added_by", F.expr("case when length(id) % 3 = 0 then 'u1' when length(id) % 3 = 1 then 'u2' end"))
    left = C.remove_suppression(owned, owned.where(F.col("id").startswith("e")).select("id"), user="u1")
    return C.suppression_view(left, user="u1").select("id", "type")


def _bounded(p: str) -> str:
    return rf"\b{p}\b"


_FLAT = D.collapse(D.sub(D.strip("text"), "<[^>]+>", " "))
_CARDS = "|".join(_bounded(p) for p in D.K.CARD_PATTERNS)
_PII = D.sub(D.sub(_FLAT, _CARDS, "[REDACTED_CARD]"), _bounded(D.K.SSN_PATTERN), "[REDACTED_SSN]")
_PII = D.sub(_PII, rf"""((?:password|passwd|pwd|secret){D.WS}*[:=]{D.WS}*["']?)[^{D.WS[1:-1]}"';,]+""", r"\1[REDACTED_SECRET]", "gi")
_PII = D.sub(_PII, _bounded(D.K.JWT_PATTERN), "[REDACTED_TOKEN]")


@query(
    "c5_redact_snippets",
    f"""with r as (select doc_id, {_PII} as c from documents) select doc_id,
    md5(c) as redacted_md5, case when length(c) > 150 then {D.strip('substring(c, 1, 150)')} || '...' else c end as snippet,
    contains(c, '[REDACTED_')::int as redacted from r""",
)
def c5(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole = P.redact_snippets(docs, "text", max_chars=None, out="whole")
    both = P.redact_snippets(whole, "whole", redact=False, out="snippet")
    return both.select(
        "doc_id", F.md5("whole").alias("redacted_md5"), "snippet", F.contains("whole", F.lit("[REDACTED_")).cast("int").alias("redacted")
    )


_LOG = D.sub("text", rf"bearer{D.WS}+[a-zA-Z0-9\-._~+/]+=*", "Bearer [REDACTED_TOKEN]", "gi")
_LOG = D.sub(_LOG, rf"""((?:api[-_]?key|token|secret)["']?{D.WS}*[:=]{D.WS}*["']?)[a-zA-Z0-9_-]{{16,}}""", r"\1[REDACTED_SECRET]", "gi")
_HOST = r"(@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)"
_LOG = D.sub(_LOG, r"(^|[^a-zA-Z0-9_.+-])[a-zA-Z0-9_.+-]{1,2}" + _HOST, r"\1*\2")
_LOG = D.sub(_LOG, r"([a-zA-Z0-9_.+-])[a-zA-Z0-9_.+-]+([a-zA-Z0-9_.+-])" + _HOST, r"\1***\2\3")
_LOG = D.sub(_LOG, r"[\r\n]+", " ")


@query(
    "c6_redact_logs",
    f"""with c as (select 'd' || doc_id as id, text from documents union all select 't' || conv_id || '-' || turn, text from conversations)
    select id, md5({_LOG}) as log_md5, (contains({_LOG}, '***') or contains({_LOG}, '[REDACTED_'))::int as changed from c""",
)
def c6(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("concat('d', doc_id) as id", "text")
    talk = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("concat('t', conv_id, '-', turn) as id", "text")
    out = P.redact_logs(docs.unionByName(talk), "text", "log")
    return out.select("id", F.md5("log").alias("log_md5"), (F.contains("log", F.lit("***")) | F.contains("log", F.lit("[REDACTED_"))).cast("int").alias("changed"))


_MASK = """case when length(split_part(email, '@', 1)) <= 2 then '*@' || split_part(email, '@', 2)
 else substring(email, 1, 1) || '***' || right(split_part(email, '@', 1), 1) || '@' || split_part(email, '@', 2) end"""


@query(
    "c7_redact_struct_logs",
    f"""with {S.rich_cte('customer')} select contact_id, '[REDACTED]' as api_key, {_MASK} as email, '[REDACTED]' as inner_token, '[Collection of 2 records]' as emails,
    '[Array of 6 items (summarized for privacy)]' as items, {_MASK} as map_email, 'call ' || {_MASK} as note from rich""",
)
def c7(spark, sf):
    rows = S.rich_contacts(spark, sf).select(
        "contact_id", F.col("context_snippet").alias("api_key"), "email",
        F.struct(F.col("email").alias("session_token"), F.concat(F.lit("call "), "email").alias("note")).alias("inner"),
        F.array("email", "domain").alias("emails"), F.array_repeat("email", 6).alias("items"),
        F.create_map(F.lit("email"), "email").alias("details"),
    )
    out = P.redact_struct_logs(rows)
    return out.select(
        "contact_id", "api_key", "email", F.col("inner.session_token").alias("inner_token"), "emails", "items",
        F.col("details.email").alias("map_email"), F.col("inner.note").alias("note"),
    )


@query("c8_mask_emails", f"with {S.contacts_cte('orders')} select contact_id, {_MASK} as masked from contacts")
def c8(spark, sf):
    return P.mask_emails(S.contacts(spark, sf, "orders"), "email", "masked").select("contact_id", "masked")


_FOLDERED = "select contact_id, cast(contact_id % 13 as STR) as folder_id, email from contacts"
_ERASED = "select distinct lower(email) from contacts where contact_id % 97 = 0"


def _erasure(spark, sf):
    contacts = S.contacts(spark, sf, "orders", S.MIXED_EMAIL)
    records = contacts.withColumn("folder_id", (F.col("contact_id") % 13).cast("string"))
    return records, contacts.where("contact_id % 97 = 0").select("email")


@query("c9_forget_email", f"with {S.contacts_cte('orders', S.MIXED_EMAIL)}, r as ({S.duck_sql(_FOLDERED)}) select contact_id, folder_id from r where lower(email) not in ({_ERASED})")
def c9(spark, sf):
    return C.forget_email(*_erasure(spark, sf)).select("contact_id", "folder_id")


@query(
    "c9_forget_report",
    f"with {S.contacts_cte('orders', S.MIXED_EMAIL)}, r as ({S.duck_sql(_FOLDERED)}) select folder_id, count(*)::bigint as deleted_records from r where lower(email) in ({_ERASED}) group by 1",
)
def c9_report(spark, sf):
    return C.forget_report(*_erasure(spark, sf))


@query(
    "c10_purge_owner",
    f"""with {S.JOBS_CTE}, {S.contacts_cte('orders')}, f as (select distinct contact_id % 13 as n from contacts)
    select (select count(*) from jobs where owner = '7')::bigint as deleted_jobs, (select count(*) from contacts where contact_id % 13 in (1, 4, 7, 10))::bigint as deleted_records,
    (select count(*) from f where n in (1, 4, 7, 10))::bigint as deleted_folders""",
)
def c10(spark, sf):
    records = S.contacts(spark, sf, "orders").withColumn("folder_id", F.when(F.col("contact_id") % 13 == 0, "default").otherwise((F.col("contact_id") % 13).cast("string")))
    folders = records.select("folder_id").distinct().withColumn(
        "owner_id", F.when(F.col("folder_id").isin("default", "1", "4", "7", "10"), "7").otherwise("8")
    )
    return P.purge_owner(S.jobs(spark, sf), folders, records, "7")["counts"]


@query(
    "c9_erase_files",
    f"with {S.contacts_cte('orders', S.MIXED_EMAIL)} select contact_id, contact_id % 7 as team, email from contacts where lower(email) not in ({_ERASED})",
)
def c9_files(spark, sf):
    """A stored folder, partitioned, of which only the files that hold an erased address are replaced."""
    path = f"{shared_dir(spark)}/erase-{uuid.uuid4().hex}"
    rows = S.contacts(spark, sf, "orders", S.MIXED_EMAIL).selectExpr("contact_id", "email", "contact_id % 7 as team")
    rows.repartition("team").write.partitionBy("team").parquet(path)
    erased = _erasure(spark, sf)[1].selectExpr("lower(trim(email)) as key")
    stored.erase_from_files(spark, path, erased, F.lower("email"))
    return spark.read.parquet(path).selectExpr("contact_id", "cast(team as bigint) as team", "email")


@query(
    "c11_retain_since",
    "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events where ts >= (select date_trunc('day', max(ts)) - interval 12 day + interval 10 hour from events)",
)
def c11_days(spark, sf):
    """Events stored by day; days before the cutoff go unread, its own day is rewritten."""
    path = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    events.withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    latest = events.agg(F.max("ts")).first()[0]
    stored.retain_since(spark, path, latest.replace(hour=10, minute=0, second=0, microsecond=0) - timedelta(days=12))
    return spark.read.parquet(path).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


_NOW = "timestamp '1998-08-02 00:00:00'"


@query(
    "c11_prune_expired",
    f"""with {S.JOBS_CTE} select job_id, status from jobs where not coalesce(status in ('completed', 'cancelled', 'failed')
    and epoch_ms({_NOW}) - epoch_ms(coalesce(ended_at, started_at)) > 24 * 3600000, false)""",
)
def c11(spark, sf):
    return P.prune_expired(S.jobs(spark, sf), F.lit("1998-08-02 00:00:00").cast("timestamp")).select("job_id", "status")


@query(
    "c12_audit_report",
    """with a as (select 'exp_' || o_orderkey as id, 'u' || (o_custkey % 5) as user_id, o_orderdate as ts, o_orderkey as record_count from orders),
    mine as (select * from a where user_id = 'u3') select id, user_id, record_count from mine""",
)
def c12(spark, sf):
    audit = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "concat('exp_', o_orderkey) as id", "concat('u', o_custkey % 5) as user_id", "cast(o_orderdate as timestamp) as timestamp", "o_orderkey as record_count"
    )
    return P.audit_report(audit, user="u3").select("id", "user_id", "record_count")
