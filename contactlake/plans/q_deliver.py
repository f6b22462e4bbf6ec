"""Registered deliverability queries (M1-M6)."""

from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.operators import deliverability as M
from contactlake.plans import ducksql as D
from contactlake.plans import seeds as S
from contactlake.plans.q_validate import _V20_SQL, _provider, facts_cte, validated
from contactlake.plans.registry import query

_BASE = f"{S.contacts_cte('orders', S.MIXED_EMAIL)}, {S.dns_cte('orders')}, doms as (select distinct lower(split_part(email, '@', 2)) as domain from contacts)"


def _domains(spark, sf):
    return S.contacts(spark, sf, "orders", S.MIXED_EMAIL).select(F.lower(F.split_part("email", F.lit("@"), F.lit(2))).alias("domain"))


@query(
    "m1_resolve_mx",
    f"""with {_BASE}, {facts_cte('doms')} select domain, has_mx::int as has_mx, has_a::int as has_a, is_null_mx::int as is_null_mx,
    coalesce(array_to_string(mx_hosts, ','), '') as mx_hosts, coalesce(hostname, '') as hostname, coalesce(priority, -1)::int as priority, coalesce(ip, '') as ip from facts""",
)
def m1(spark, sf):
    out = M.resolve_mx(_domains(spark, sf), S.dns(spark, sf, "orders"))
    return out.select(
        "domain", *[F.col(c).cast("int").alias(c) for c in ("has_mx", "has_a", "is_null_mx")],
        F.coalesce(F.array_join("mx_hosts", ","), F.lit("")).alias("mx_hosts"), F.coalesce("hostname", F.lit("")).alias("hostname"),
        F.coalesce("priority", F.lit(-1)).alias("priority"), F.coalesce("ip", F.lit("")).alias("ip"),
    )


_HOSTS = """contact_id, AT(ARR('aspmx.l.google.com','mx1.pphosted.com','eu.mail.protection.outlook.com','mx.zoho.eu','in.iphmx.com',
 'inbound-smtp.us-east-1.amazonaws.com','mail.ovh.net','mx.proofpoint.example mx.google.com','d1.barracuda.net','mta.yahoodns.net','self.hosted'),
 cast(contact_id % 11 as int) + 1) || cast(contact_id as STR) as host"""
_ANY, _ANY_RISK = _provider(K.PROVIDERS_ANY_HOST, "host", K.PROVIDER_ANY_HOST_DEFAULT)
_PRIMARY, _PRIMARY_RISK = _provider(K.PROVIDERS_PRIMARY_HOST, "host", K.PROVIDER_PRIMARY_HOST_DEFAULT)


def _hosts(spark, sf):
    S.contacts(spark, sf, "orders").createOrReplaceTempView("contacts")
    return spark.sql(f"select {S.spark_sql(_HOSTS)} from contacts")


@query(
    "m2_fingerprint_provider",
    f"""with {S.contacts_cte('orders')}, h as (select {S.duck_sql(_HOSTS)} from contacts)
    select contact_id, {_ANY} as provider, ({_ANY_RISK})::int as is_catch_all, {_PRIMARY} as primary_provider, ({_PRIMARY_RISK})::int as primary_catch_all from h""",
)
def m2(spark, sf):
    any_host = M.fingerprint_provider(_hosts(spark, sf), "host", K.PROVIDERS_ANY_HOST, K.PROVIDER_ANY_HOST_DEFAULT)
    kept = any_host.select("contact_id", "host", F.col("provider").alias("p"), F.col("is_catch_all").cast("int").alias("c"))
    out = M.fingerprint_provider(kept, "host")
    return out.select(
        "contact_id", F.col("p").alias("provider"), F.col("c").alias("is_catch_all"), F.col("provider").alias("primary_provider"),
        F.col("is_catch_all").cast("int").alias("primary_catch_all"),
    )


_NET = {
    f: "coalesce(case " + " ".join(f"when contains(host, '{n[0]}') then {D.lit(n[i])}" for n in K.MX_NETWORKS) + " end, '')"
    for i, f in enumerate(("isp", "asn", "country", "city"), start=1)
}


@query(
    "m3_enrich_asn",
    f"""with {S.contacts_cte('orders')}, h as (select {S.duck_sql(_HOSTS)} from contacts)
    select contact_id, {', '.join(f'{sql} as {f}' for f, sql in _NET.items())} from h""",
)
def m3(spark, sf):
    out = M.enrich_asn(_hosts(spark, sf), "host")
    return out.select("contact_id", *[F.coalesce(f, F.lit("")).alias(f) for f in ("isp", "asn", "country", "city")])


_STATUS_SQL = _V20_SQL.split(" select contact_id, (passed")[0]


@query("m4_mailbox_status", f"{_STATUS_SQL} select mailbox_status, provider, count(*)::bigint as n from vd group by 1, 2")
def m4(spark, sf):
    return validated(spark, sf).groupBy("mailbox_status", "provider").agg(F.count("*").alias("n"))


_JOINED, _JOINED_RISK = _provider(K.PROVIDERS_ANY_HOST, "joined", K.PROVIDER_ANY_HOST_DEFAULT)
_DISPOSABLE = f"c.domain in {D.in_list(K.DISPOSABLE_DOMAINS)}"


@query(
    "m5_verify_domains",
    f"""with {S.rich_cte('orders', S.MIXED_EMAIL)}, {S.dns_cte('orders')},
    recs as (select lower(domain) as domain, list(trim(data) order by trim(data)) as records from dns where rr_type = 15 group by 1),
    named as (select *, {_JOINED} as p, {_JOINED_RISK} as r from (select *, lower(array_to_string(records, ' ')) as joined from recs))
    select contact_id, case when {_DISPOSABLE} then 'disposable' when n.domain is null then 'undeliverable' when r then 'risky' else 'deliverable' end as mx_status,
    case when {_DISPOSABLE} then {D.lit(K.LABEL_DISPOSABLE_SIMPLE)} when n.domain is null then {D.lit(K.LABEL_NO_MX)} else p end as provider,
    case when {_DISPOSABLE} then '' else coalesce(array_to_string(records, ','), '') end as mx_records,
    (coalesce(r, false) and not {_DISPOSABLE})::int as is_catch_all
    from rich c left join named n on c.domain = n.domain""",
)
def m5(spark, sf):
    out = M.verify_domains(S.rich_contacts(spark, sf, "orders", S.MIXED_EMAIL), S.dns(spark, sf, "orders"))
    return out.select(
        "contact_id", "mx_status", "provider", F.array_join("mx_records", ",").alias("mx_records"),
        F.col("is_catch_all").cast("int").alias("is_catch_all"),
    )


@query(
    "m6_verification_view",
    f"""{_STATUS_SQL}, en as (select *, mailbox_status in ('deliverable', 'risky') as has_block from vd)
    select contact_id, {D.canonical('email')} as canonical_email, mailbox_status, coalesce(typo_suggestion, '') as typo_suggestion,
    (domain in {D.in_list(K.FREEMAIL_DOMAINS)})::int as is_free_mail, ent as entropy_score, checks_passed::int as checks_passed,
    case when has_block then coalesce(country, 'Unknown') else 'Unknown' end as country, case when has_block then coalesce(isp, 'Unknown ISP') else 'Unknown ISP' end as isp,
    0 as proof_of_mailbox_existence, {D.lit(K.VERIFICATION_TYPE)} as verification_type from en""",
)
def m6(spark, sf):
    v = validated(spark, sf)
    view = M.verification_view(v.withColumn("email", F.concat_ws("|", "email", F.col("contact_id").cast("string"))))
    c = F.col
    return view.select(
        F.split_part("email", F.lit("|"), F.lit(2)).cast("bigint").alias("contact_id"), "canonical_email", "mailbox_status",
        F.coalesce("typo_suggestion", F.lit("")).alias("typo_suggestion"),
        c("intelligence_flags.is_free_mail").cast("int").alias("is_free_mail"), c("intelligence_flags.entropy_score").alias("entropy_score"),
        c("intelligence_flags.static_checks.checks_passed").alias("checks_passed"), c("mx_enrichment.country").alias("country"),
        c("mx_enrichment.isp").alias("isp"), c("proof_of_mailbox_existence").cast("int").alias("proof_of_mailbox_existence"), "verification_type",
    )
