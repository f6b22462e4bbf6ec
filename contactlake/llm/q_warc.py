"""Query of the revisit resolution: captures derived from the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.llm import revisits
from contactlake.llm.registry import query

# Per page one full response and three revisits: soon after with its entity tag, much later with a weak
# tag or a date, and before it without validators.
def records(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = F.coalesce("html", F.lit(""))
    facts = pages.select(
        "page_id", "url", F.concat(F.lit('"'), F.substring(F.md5(html), 1, 16), F.lit('"')).alias("tag"),
        F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string")).alias("stamp"),
        F.sha2(html, 256).alias("sha"), F.length(html).cast("long").alias("chars"),
    )

    def h(name, value):
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(as_column(name).alias("name"), as_column(value).alias("value"))

    page, at = F.col("page_id").cast("string"), F.col("page_id") * 10
    none = F.lit(None)
    even = F.col("page_id") % 2 == 0

    def capture(letter, kind, time, headers, full=False):
        return F.struct(
            F.concat(F.lit(letter), page).alias("record_id"), F.lit(kind).alias("kind"), time.alias("captured_at"),
            F.array(*headers).alias("headers"),
            (F.col("sha") if full else none.cast("string")).alias("payload_sha256"),
            (F.col("chars") if full else none.cast("long")).alias("payload_chars"),
        )

    captures = F.array(
        capture("r", "response", at + 1_000_000, [
            h("Content-Type", "text/html"), h("Content-Length", F.col("chars").cast("string")), h("ETag", F.col("tag")),
            h("Last-Modified", F.col("stamp")), h("Cache-Control", F.concat(F.lit("max-age="), (F.col("page_id") % 100).cast("string"))),
            h("Date", page),
        ], full=True),
        capture("a", "revisit", at + 1_000_005, [h("etag", F.col("tag")), h("Date", F.concat(F.lit("a"), page)), h("Content-Length", "0")]),
        capture("b", "revisit", at + 90_000_000_000, [
            h(F.when(even, "ETag").otherwise("Last-Modified"), F.when(even, F.concat(F.lit("W/"), F.col("tag"))).otherwise(F.col("stamp"))),
            h("Set-Cookie", "x"), h("Expires", "never"), h("Cache-Control", "no-cache"),
        ]),
        capture("c", "revisit", at + 999_995, [h("Date", "c")]),
    )
    return facts.select("url", F.explode(captures).alias("__c")).select("url", "__c.*")


_SQL = """
with facts as (
  select page_id, url, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' as tag, 'day ' || (page_id % 1000) as stamp,
    sha256(coalesce(html, '')) as sha, cast(length(coalesce(html, '')) as bigint) as chars
  from pages),
records as (
select concat('r', cast(page_id as varchar)) as record_id, 'response' as kind, url, 1000000 + page_id * 10 as captured_at,
  list_value({'name': 'Content-Type', 'value': 'text/html'}, {'name': 'Content-Length', 'value': cast(chars as varchar)}, {'name': 'ETag', 'value': tag}, {'name': 'Last-Modified', 'value': stamp},
    {'name': 'Cache-Control', 'value': concat('max-age=', cast(page_id % 100 as varchar))}, {'name': 'Date', 'value': cast(page_id as varchar)}) as headers, sha, chars
from facts
union all
select concat('a', cast(page_id as varchar)), 'revisit', url, 1000005 + page_id * 10,
  list_value({'name': 'etag', 'value': tag}, {'name': 'Date', 'value': concat('a', cast(page_id as varchar))}, {'name': 'Content-Length', 'value': '0'}), null, null
from facts
union all
select concat('b', cast(page_id as varchar)), 'revisit', url, 90000000000 + page_id * 10,
  list_value({'name': case when page_id % 2 = 0 then 'ETag' else 'Last-Modified' end, 'value': case when page_id % 2 = 0 then concat('W/', tag) else stamp end},
    {'name': 'Set-Cookie', 'value': 'x'}, {'name': 'Expires', 'value': 'never'}, {'name': 'Cache-Control', 'value': 'no-cache'}), null, null
from facts
union all
select concat('c', cast(page_id as varchar)), 'revisit', url, 999995 + page_id * 10, list_value({'name': 'Date', 'value': 'c'}), null, null
from facts
),
bare as (
  select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from records),
params as (
  select *, array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'),
    lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)='))), '&') as q from bare),
keyed as (
  select * exclude (bare, q), coalesce(
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^[^@]*@', ''), ':(80|443)$', ''), '^www\\.', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') || case when q <> '' then '?' || q else '' end, '') as k,
    regexp_replace(trim(list_filter(headers, lambda h: lower(h.name) = 'etag')[1].value), '^W/', '') as etag,
    trim(list_filter(headers, lambda h: lower(h.name) = 'last-modified')[1].value) as modified
  from params),
responses as (
  select k, captured_at, max_by(record_id, record_id) as record_id, max_by(headers, record_id) as headers, max_by(etag, record_id) as etag,
    max_by(modified, record_id) as modified, max_by(sha, record_id) as sha, max_by(chars, record_id) as chars
  from keyed where kind = 'response' group by k, captured_at),
joined as (
  select v.record_id as revisit_id, v.headers as fresh, r.headers as stored, r.record_id as rid, r.sha as rsha, r.chars as rchars,
    case when r.record_id is null then 'missing'
      when v.etag is not null then case when v.etag = r.etag then 'resolved' else 'mismatch' end
      when v.modified is not null then case when v.modified = r.modified then 'resolved' else 'mismatch' end
      else 'unvalidated' end as outcome
  from (select * from keyed where kind = 'revisit') v
  asof left join responses r on v.k = r.k and v.captured_at > r.captured_at),
allowed as (
  select *, list_filter(fresh, lambda h: lower(h.name) in ('cache-control', 'content-location', 'date', 'etag', 'expires', 'last-modified', 'vary')) as ok
  from joined),
merged as (
  select *, outcome in ('resolved', 'unvalidated') as found,
    list_concat(list_filter(stored, lambda h: not list_contains(list_transform(ok, lambda x: lower(x.name)), lower(h.name))), ok) as headers
  from allowed)
select revisit_id, outcome, case when found then rid end as response_id,
  case when found then array_to_string(list_transform(headers, lambda h: h.name || ': ' || h.value), chr(10)) end as headers_text,
  case when found then rsha end as payload_sha256, case when found then rchars end as payload_chars
from merged
"""


@query("op1_revisits", _SQL)
def op1_revisits(spark, sf_dir):
    resolved = revisits.resolve_revisits(records(spark, sf_dir))
    lines = F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"]))
    return resolved.select(
        "revisit_id", "outcome", "response_id", F.array_join(lines, "\n").alias("headers_text"),
        "payload_sha256", "payload_chars",
    )
