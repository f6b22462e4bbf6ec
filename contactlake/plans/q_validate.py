"""Registered validation queries."""

from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.operators import validation as V
from contactlake.plans import ducksql as D
from contactlake.plans import seeds as S
from contactlake.plans.contacts import validate_contacts
from contactlake.plans.registry import query

_L, _D = "split_part(lower(email), '@', 1)", "split_part(lower(email), '@', 2)"
_LABELS = f"string_split({_D}, '.')"
_TLD = f"list_extract({_LABELS}, -1)"
_RESERVED_TLD, _RESERVED_DOM = f"{_TLD} in {D.in_list(K.RESERVED_TLDS)}", f"{_D} in {D.in_list(K.RESERVED_DOMAINS)}"
_TYPO = D.typo_target(_D)
_TESTS = {
    "rfc5321_syntax": "length(email) - length(replace(email, '@', '')) = 1 and length(email) <= 254 and not contains(email, ' ') and not contains(email, '..')",
    "rfc1035_labels": f"len({_LABELS}) >= 2 and len(list_filter({_LABELS}, lambda x: not (length(x) between 1 and 63 and regexp_matches(x, {D.lit('(?i)' + K.DNS_LABEL)})))) = 0",
    "reserved": f"not ({_RESERVED_TLD} or {_RESERVED_DOM})",
    "iana_tld": f"{D.tld_known(_TLD)} and not {_RESERVED_TLD}",
    "disposable": f"{_D} not in {D.in_list(K.DISPOSABLE_DOMAINS)}",
    "role_account": "true",
    "freemail": "true",
    "gibberish": f"not {D.gibberish(_L, 'ent')}",
    "typo": "typo is null",
    "local_format": f"length({_L}) between 1 and 64 and not starts_with({_L}, '.') and not ends_with({_L}, '.')",
    "local_charset": f"regexp_matches({_L}, {D.lit(D.DOT_ATOM)})",
    "spam_trap": f"{_L} not in {D.in_list(K.SPAM_TRAPS)}",
    "fqdn": f"not regexp_matches({_D}, '^\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}$')",
    "subdomain_depth": f"len({_LABELS}) <= 5",
    "punycode": f"not contains({_D}, 'xn--') or regexp_matches(list_extract({_LABELS}, 1), '(?i)^xn--[a-z0-9\\-]+$')",
    "canonical_form": "true",
}
_R = K.CHECK_REASONS


def _filled(template: str, value: str) -> str:
    a, b = template.split("{}")
    return f"{D.lit(a)} || {value} || {D.lit(b)}"


_REASONS = {
    "reserved": f"case when {_RESERVED_DOM} then {_filled(_R['reserved_domain'], _D)} else {_filled(_R['reserved_tld'], _TLD)} end",
    "iana_tld": f"case when not {D.tld_known(_TLD)} then {_filled(_R['iana_tld'], _TLD)} end",
    "gibberish": _filled(_R["gibberish"], "regexp_replace(ent::varchar, '\\.0$', '')"),
    "typo": _filled(_R["typo"], "typo"),
}


def static_cte(source: str, email: str = S.EMAIL) -> str:
    """contacts -> st: all checks, reasons and the roll-up."""
    order = [c for c, _, _ in K.STATIC_CHECKS]
    checks = ", ".join(f"({_TESTS[c]}) as chk_{c}" for c in order)
    listed = [(c, t, f) for c, t, f in K.STATIC_CHECKS if c not in ("role_account", "freemail", "canonical_form")]
    reasons = ", ".join(f"case when not chk_{c} then {_REASONS.get(c) or D.lit(_R[c])} end as reason_{c}" for c, _, _ in listed)
    passed = " + ".join(f"chk_{c}::int" for c in order)
    failed = ", ".join(f"case when reason_{c} is not null then {D.lit(t + ': ')} || reason_{c} end" for c, t, _ in listed)
    fatal = " and ".join(f"reason_{c} is null" for c, _, f in listed if f)
    return f"""{S.contacts_cte(source, email)},
    s1 as (select *, {D.entropy(_L)} as ent, {_TYPO} as typo, {_D} as domain from contacts),
    s2 as (select *, {checks} from s1),
    s3 as (select *, {reasons}, {passed} as checks_passed from s2),
    st as (select *, {fatal} as passed, floor(checks_passed * 100.0 / 16 + 0.5)::int as score,
      list_filter([{failed}], lambda x: x is not null) as failed_checks,
      case when typo is not null then {_L} || '@' || typo end as typo_suggestion from s3)"""


def _static(spark, sf, source="customer"):
    return V.validate_static(S.contacts(spark, sf, source))


_VALUES = {
    "role_account": ("is_role_account", f"({_L} in {D.in_list(K.ROLE_ACCOUNTS)})::int"),
    "freemail": ("is_free_mail", f"({_D} in {D.in_list(K.FREEMAIL_DOMAINS)})::int"),
}


def _register_checks():
    for number, (check, _, _) in enumerate(K.STATIC_CHECKS, start=1):
        column, sql = _VALUES.get(check, (f"chk_{check}", f"chk_{check}::int"))
        extra_sql, extra = "", []
        if check == "gibberish":
            extra_sql, extra = ", ent as entropy_score", ["entropy_score"]
        elif check == "typo":
            extra_sql, extra = ", coalesce(typo_suggestion, '') as typo_suggestion", ["typo_suggestion"]
        elif check == "canonical_form":
            extra_sql, extra = f", {D.canonical('email')} as canonical_email", ["canonical_email"]

        def run(spark, sf, column=column, extra=tuple(extra)):
            out = _static(spark, sf).withColumn("typo_suggestion", F.coalesce("typo_suggestion", F.lit("")))
            return out.select("contact_id", F.col(column).cast("int").alias(column), *extra)

        query(f"v{number}_{check}", f"with {static_cte('customer')} select contact_id, {sql} as {column}{extra_sql} from st")(run)


_register_checks()


@query(
    "v17_validation_rollup",
    f"""with {static_cte('lineitem')} select contact_id, checks_passed::int as checks_passed, score, passed::int as passed,
    array_to_string(failed_checks, ' | ') as failed_checks from st""",
)
def v17(spark, sf):
    return _static(spark, sf, "lineitem").select(
        "contact_id", "checks_passed", "score", F.col("passed").cast("int").alias("passed"),
        F.array_join("failed_checks", " | ").alias("failed_checks"),
    )


@query(
    "v18_dedupe_canonical",
    f"""with {S.contacts_cte('lineitem')}, c as (select *, {D.canonical('email')} as canonical_email from contacts)
    select canonical_email, min_by(email, contact_id) as kept_email, count(*)::bigint as n_rows, count(distinct email)::bigint as n_aliases
    from c group by 1""",
)
def v18(spark, sf):
    return V.dedupe_canonical(S.contacts(spark, sf, "lineitem"), "contact_id")


_FIX = "case split_part(email, '@', 2) " + " ".join(f"when '{k}' then '{v}'" for k, v in K.TYPO_DOMAINS.items()) + " end"


@query(
    "v19_fix_domain_typos",
    f"""with {S.rich_cte('orders')}, f as (select *, {_FIX} as fix from rich) select contact_id,
    case when fix is not null then split_part(email, '@', 1) || '@' || fix else email end as email, coalesce(fix, domain) as domain,
    case when fix is not null then 'pending' else mx_status end as mx_status, (fix is not null)::int as typo_fixed from f""",
)
def v19(spark, sf):
    out = V.fix_domain_typos(S.rich_contacts(spark, sf, "orders"))
    return out.select("contact_id", "email", "domain", "mx_status", F.col("typo_fixed").cast("int").alias("typo_fixed"))


def _provider(rules, host, default):
    whens = " ".join("when " + " or ".join(f"contains({host}, '{k}')" for k in keys) + f" then {D.lit(name)}" for keys, name, _ in rules)
    risk = " ".join("when " + " or ".join(f"contains({host}, '{k}')" for k in keys) + f" then {str(c).lower()}" for keys, _, c in rules)
    return f"case {whens} else {D.lit(default)} end", f"case {risk} else false end"


MX_CTE = """mx as (select lower(domain) as domain, try_cast(regexp_extract(list_extract(regexp_split_to_array(trim(data), '\\s+'), 1), '^[+-]?\\d+') as int) as raw_p,
   lower(regexp_replace(coalesce(list_extract(regexp_split_to_array(trim(data), '\\s+'), 2), ''), '\\.$', '')) as host from dns where rr_type = 15 and length(data) > 0),
 mx2 as (select *, case when raw_p is null or raw_p = 0 then 10 else raw_p end as priority from mx),
 ans as (select domain, list(host order by priority, host) filter (where host <> '') as hosts,
   (min_by(struct_pack(h := host, p := priority), struct_pack(p := priority, h := host)) filter (where host <> '')) as first,
   bool_or(coalesce(raw_p = 0, false) and host = '') as is_null_mx from mx2 group by domain),
 arec as (select lower(domain) as domain, min(trim(data)) as ip from dns where rr_type = 1 group by 1)"""
_PROV, _RISK = _provider(K.PROVIDERS_PRIMARY_HOST, "hostname", K.PROVIDER_PRIMARY_HOST_DEFAULT)


def facts_cte(domains: str) -> str:
    net = {
        f: "case " + " ".join(f"when contains(hostname, '{n[0]}') then {D.lit(n[i])}" for n in K.MX_NETWORKS) + " end"
        for i, f in enumerate(("isp", "asn", "country", "city"), start=1)
    }
    return f"""{MX_CTE}, fa as (select d.domain, coalesce(len(ans.hosts), 0) > 0 as has_mx, coalesce(len(ans.hosts), 0) = 0 and arec.ip is not null as has_a,
   coalesce(ans.is_null_mx, false) as is_null_mx, ans.hosts as mx_hosts,
   case when len(ans.hosts) > 0 then ans.first.h when arec.ip is not null then d.domain end as hostname,
   case when len(ans.hosts) > 0 then ans.first.p when arec.ip is not null then 0 end as priority,
   case when coalesce(len(ans.hosts), 0) = 0 then arec.ip end as own_ip
   from (select distinct domain from {domains}) d left join ans on d.domain = ans.domain left join arec on d.domain = arec.domain),
 facts as (select fa.*, coalesce(own_ip, h.ip) as ip, {_PROV} as provider, {_RISK} as is_catch_all,
   {net['isp']} as isp, {net['asn']} as asn, {net['country']} as country, {net['city']} as city
   from fa left join arec h on fa.hostname = h.domain)"""


def verdict_cte() -> str:
    """st + facts -> vd: status, provider, MX block."""
    dis = "not chk_disposable"
    nodns = "not coalesce(has_mx, false) and not coalesce(has_a, false)"
    return f"""jn as (select st.*, facts.* exclude (domain) from st left join facts on st.domain = facts.domain),
 vd as (select * exclude (provider, is_catch_all), case when {dis} then 'disposable' when not passed or coalesce(is_null_mx, false) or ({nodns}) then 'undeliverable'
   when coalesce(is_catch_all, false) then 'risky' else 'deliverable' end as mailbox_status,
   case when {dis} then {D.lit(K.LABEL_DISPOSABLE)} when not passed then {D.lit(K.LABEL_FAILED_STATIC)} when coalesce(is_null_mx, false) then {D.lit(K.LABEL_NULL_MX)}
   when {nodns} then {D.lit(K.LABEL_NO_DNS)} else provider end as provider from jn)"""


_V20_SQL = f"""with {static_cte('orders', S.MIXED_EMAIL)}, {S.dns_cte('orders')}, {facts_cte('(select domain from st where passed)')}, {verdict_cte()}
 select contact_id, (passed and mailbox_status <> 'undeliverable')::int as valid, mailbox_status, provider, score,
 case when mailbox_status in ('deliverable', 'risky') then coalesce(hostname, '') else '' end as hostname,
 case when mailbox_status in ('deliverable', 'risky') then coalesce(ip, '') else '' end as ip from vd"""


def validated(spark, sf, source="orders"):
    return validate_contacts(S.contacts(spark, sf, source, S.MIXED_EMAIL), S.dns(spark, sf, source))


@query("v20_validate_contacts", _V20_SQL)
def v20(spark, sf):
    return validated(spark, sf).select(
        "contact_id", F.col("valid").cast("int").alias("valid"), "mailbox_status", "provider", "score",
        F.coalesce("mx_enrichment.hostname", F.lit("")).alias("hostname"), F.coalesce("mx_enrichment.ip", F.lit("")).alias("ip"),
    )


@query(
    "v21_validation_summary",
    f"""with {static_cte('orders', S.MIXED_EMAIL)}, {S.dns_cte('orders')}, {facts_cte('(select domain from st where passed)')}, {verdict_cte()}
    select count(*)::bigint as total, (count(*) filter (where mailbox_status = 'deliverable'))::bigint as deliverable,
    (count(*) filter (where mailbox_status = 'undeliverable'))::bigint as undeliverable, (count(*) filter (where mailbox_status = 'disposable'))::bigint as disposable,
    (count(*) filter (where mailbox_status = 'risky'))::bigint as risky, 0::bigint as pending, (count(*) filter (where checks_passed < 16))::bigint as layer1_filtered,
    printf('%.1f%%', (count(*) filter (where checks_passed < 16)) * 100.0::double / count(*)) as layer1_filter_rate from vd""",
)
def v21(spark, sf):
    return V.validation_summary(validated(spark, sf))


_ROWS = """contact_id, case contact_id % 5 when 0 then concat(email, ' x') when 1 then 'a@b' else email end as email,
 AT(ARR('https://acme-demo.com/a','ftp://acme-demo.com','http://','https://acme-demo.com/b'), cast(contact_id % 4 as int) + 1) as url,
 case contact_id % 6 when 0 then 'phone' else 'email' end as kind"""


@query(
    "v22_syntax_filter_records",
    f"""with {S.contacts_cte('orders')}, r as (select {S.duck_sql(_ROWS)} from contacts)
    select contact_id, array_to_string(list_filter([case when not (length(email) between 3 and 320 and regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')) then 'email' end,
    case when contact_id % 4 in (1, 2) then 'url' end, case when contact_id % 6 = 0 then 'suppression' end], lambda x: x is not null), ',') as violations from r
    where not (length(email) between 3 and 320 and regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')) or contact_id % 4 in (1, 2) or contact_id % 6 = 0""",
)
def v22(spark, sf):
    S.contacts(spark, sf, "orders").createOrReplaceTempView("contacts")
    rows = spark.sql(f"select {S.spark_sql(_ROWS)} from contacts")
    rules = {
        "email": V.email_ok(F.col("email")), "url": V.url_ok(F.col("url")),
        "suppression": V.suppression_ok(F.col("kind"), F.col("email")),
    }
    _, bad = V.syntax_filter_records(rows, rules)
    return bad.select("contact_id", F.array_join("violations", ",").alias("violations"))
