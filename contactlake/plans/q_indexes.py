"""Registered queries whose rules, ranges and targets are tables."""

from pyspark.sql import functions as F

from contactlake.operators import deliverability as V
from contactlake.operators import policy as P
from contactlake.operators.ranges import longest_match
from contactlake.operators.typos import nearest_target
from contactlake.plans import seeds as S
from contactlake.plans.registry import query

# IPv4 networks nested in one another, and IPv6 ones of two lengths.
_RANGE = """case when k % 4 = 0 then concat(cast(k % 223 + 1 as STR), '.', cast(k % 251 as STR), '.0.0/16')
  when k % 4 = 1 then concat(cast(k % 223 + 1 as STR), '.', cast(k % 251 as STR), '.', cast(k % 256 as STR), '.0/24')
  when k % 4 = 2 then concat('2001:db8:', HEX(k % 97), '::/48') else concat('2001:DB8:', HEX(k % 97), ':0:0:0:', HEX(k % 13), ':0/112') end"""
_IP = """case when k % 3 = 0 then concat(cast(k % 223 + 1 as STR), '.', cast(k % 251 as STR), '.', cast(k % 256 as STR), '.', cast(k % 250 as STR))
  when k % 3 = 1 then concat('2001:db8:', HEX(k % 97), '::', HEX(k % 13), ':', HEX(k % 65536)) else concat('host', cast(k as STR), '.com') end"""
_BASE6, _TWO80 = "42540766411282592856903984951653826560::hugeint", "1208925819614629174706176::hugeint"


def _spark(t):
    return S.spark_sql(t).replace("HEX(", "lower(hex(").replace("% 97)", "% 97))").replace("% 13)", "% 13))").replace("% 65536)", "% 65536))")


def _duck(t):
    return S.duck_sql(t).replace("HEX(", "format('{:x}', ")


@query(
    "c16_range_table",
    f"""with r as (select distinct {_duck(_RANGE)} as cidr, case when k % 4 < 2 then 4 else 6 end as family,
      case k % 4 when 0 then 16 when 1 then 24 when 2 then 48 else 112 end as len,
      case k % 4 when 0 then (k % 223 + 1) * 16777216 + k % 251 * 65536 when 1 then (k % 223 + 1) * 16777216 + k % 251 * 65536 + k % 256 * 256
        when 2 then {_BASE6} + (k % 97) * {_TWO80} else {_BASE6} + (k % 97) * {_TWO80} + k % 13 * 65536 end as low,
      case k % 4 when 0 then 65536 when 1 then 256 when 2 then {_TWO80} else 65536 end as size from (select c_custkey as k from customer)),
    a as (select k, {_duck(_IP)} as ip, case k % 3 when 0 then 4 when 1 then 6 end as family,
      case k % 3 when 0 then (k % 223 + 1) * 16777216 + k % 251 * 65536 + k % 256 * 256 + k % 250 when 1 then {_BASE6} + (k % 97) * {_TWO80} + k % 13 * 65536 + k % 65536 end as n
      from (select o_orderkey as k from orders)),
    m as (select k, arg_max(cidr, len) as cidr from a join r on a.family = r.family and a.n between r.low and r.low + r.size - 1 group by k)
    select a.k as address_id, a.ip, coalesce(m.cidr, '') as cidr from a left join m on a.k = m.k""",
)
def c16_ranges(spark, sf):
    ranges = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey as k").selectExpr(f"{_spark(_RANGE)} as cidr").distinct()
    keys = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey as k")
    rows = keys.selectExpr("k as address_id", f"{_spark(_IP)} as ip")
    return longest_match(rows, ranges).withColumn("cidr", F.coalesce("cidr", F.lit("")))


@query(
    "c16_url_safety_ranges",
    f"""with {S.contacts_cte('orders')}, r as (select distinct o_orderkey % 200 as n from orders)
    select contact_id, case when contact_id % 4 = 0 and contact_id % 250 in (select n from r) then 'restricted_ip'
      when contact_id % 4 = 1 and contact_id % 250 in (select n from r) then 'resolves_to_restricted_ip'
      when contact_id % 4 = 2 and contact_id % 250 in (select n from r) then 'resolves_to_restricted_ip' else '' end as unsafe_reason from contacts""",
)
def c16_url_ranges(spark, sf):
    c = S.contacts(spark, sf, "orders")
    ranges = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "explode(array(concat('93.', o_orderkey % 200, '.0.0/16'), concat('2606:', lower(hex(o_orderkey % 200)), '::/32'))) as cidr"
    )
    urls = c.selectExpr("contact_id", "case when contact_id % 4 = 0 then concat('http://93.', contact_id % 250, '.7.9/x') else concat('https://Host', contact_id, '.com/p') end as url")
    resolved = c.where("contact_id % 4 > 0").selectExpr(
        "concat('host', contact_id, '.com') as host",
        "case contact_id % 4 when 1 then concat('93.', contact_id % 250, '.1.2') when 2 then concat('2606:', lower(hex(contact_id % 250)), '::1') else '8.8.8.8' end as ip",
    )
    return P.url_safety(urls, resolved, ranges=ranges).select("contact_id", F.coalesce("unsafe_reason", F.lit("")).alias("unsafe_reason"))


_PATTERN = """case when k % 300 = 2 then '.IO' when k % 3 = 0 then concat('mx', cast(k as STR), '.') when k % 3 = 1 then concat('corp', cast(k % 50 as STR), '.net')
  else concat('7', cast(k % 900 as STR), '.c') end"""
_HOST = """concat('MX', cast(contact_id % 3000 as STR), '.corp', cast(contact_id % 80 as STR), AT(ARR('.net', '.com', '.io'), cast(contact_id % 3 as int) + 1))"""
_RULES = f"""{S.contacts_cte('orders')}, h as (select contact_id, {_duck(_HOST)} as host from contacts), r as (select k as ord, {_duck(_PATTERN)} as pattern from (select c_custkey as k from customer)),
  d as (select distinct host from h), b as (select host, min(ord) as ord from d join r on contains(lower(host), lower(pattern)) group by host)"""


def _hosts_and_rules(spark, sf):
    hosts = S.contacts(spark, sf, "orders").selectExpr("contact_id", f"{_spark(_HOST)} as host")
    return hosts, spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey as k").selectExpr("k as ord", f"{_spark(_PATTERN)} as pattern")


@query(
    "m2_rule_table",
    f"""with {_RULES} select contact_id, h.host, case when ord is null then 'Other' else 'P' || ord end as provider, coalesce(ord % 2 = 0, false) as is_catch_all
    from h left join b on h.host = b.host""",
)
def m2_rules(spark, sf):
    hosts, rules = _hosts_and_rules(spark, sf)
    rules = rules.selectExpr("*", "concat('P', ord) as provider", "ord % 2 = 0 as is_catch_all")
    return V.fingerprint_provider(hosts, "host", rules, "Other")


@query(
    "m3_network_table",
    f"""with {_RULES} select contact_id, h.host, 'I' || ord as isp, 'AS' || ord as asn, 'C' || ord % 9 as country, 'T' || ord % 7 as city
    from h left join b on h.host = b.host""",
)
def m3_networks(spark, sf):
    hosts, rules = _hosts_and_rules(spark, sf)
    networks = rules.selectExpr("*", "concat('I', ord) as isp", "concat('AS', ord) as asn", "concat('C', ord % 9) as country", "concat('T', ord % 7) as city")
    return V.enrich_asn(hosts, "host", networks)


_DOMAIN = """AT(ARR(concat('corp', cast(contact_id % 2000 as STR), '.com'), concat('crop', cast(contact_id % 2000 as STR), '.com'),
  concat('corp', cast(contact_id % 2000 as STR), '.co'), concat('cor', cast(contact_id % 2000 as STR), 'x.comm'), concat(' Corp', cast(contact_id % 2000 as STR), '.con ')), cast(contact_id % 5 as int) + 1)"""


@query(
    "v9_typo_table",
    f"""with {S.contacts_cte('orders')}, d as (select contact_id, {_duck(_DOMAIN)} as domain from contacts), t as (select c_custkey as ord, 'corp' || c_custkey || '.com' as target from customer),
    u as (select distinct trim(lower(domain)) as d from d), w as (select d from u where d not in (select target from t)),
    b as (select d, arg_min(target, ord) as target from w join t on abs(length(d) - length(target)) <= 1 and levenshtein(d, target) between 1 and 2 group by d)
    select contact_id, domain, coalesce(target, '') as typo_target from d left join b on trim(lower(d.domain)) = b.d""",
)
def v9_targets(spark, sf):
    rows = S.contacts(spark, sf, "orders").selectExpr("contact_id", f"{_spark(_DOMAIN)} as domain")
    targets = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey as ord", "concat('corp', c_custkey, '.com') as target")
    return nearest_target(rows, targets).withColumn("typo_target", F.coalesce("typo_target", F.lit("")))
