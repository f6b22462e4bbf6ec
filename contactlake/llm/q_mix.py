"""Query of the source mix."""

from __future__ import annotations

from contactlake.llm import pareto_mix
from contactlake.llm.registry import documents, query

_SQL = r"""
with sized as (
  select doc_id, source, coalesce(cast(doc_id as varchar), '') as k,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents),
per as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighted as (
  select *, [5, 2, 1][cast((row_number() over (order by source asc nulls last) - 1) % 3 as int) + 1] as w, 3 * source_size as cap
  from per),
levels as (
  select *, row_number() over o as i,
    (cast(sum(source_size) over () as double) - coalesce(cast(sum(cap) over (o rows between unbounded preceding and 1 preceding) as double), 0))
    / cast(sum(w) over (o rows between current row and unbounded following) as double) as level
  from weighted window o as (order by cap / w, source nulls last)),
first as (select min(i) as i from levels where level * w <= cap),
shared as (select level from levels where i = (select i from first)),
targets as (
  select source, source_size,
    case when i < (select i from first) then cast(cap as double) else (select level from shared) * w end as target
  from levels),
ranked as (
  select s.*, t.source_size, t.target,
    case when source_size > 0 then least(target / source_size, 3.0) else 0.0 end as e,
    (cast(cast('0x' || substr(md5('mix-1:' || k), 1, 13) as bigint) as double) + 0.5) / 4503599627370496.0 as u
  from sized s join targets t on s.source is not distinct from t.source),
parts as (select *, floor(e) as whole, e - floor(e) as p from ranked),
odds as (select *, case when p > 0 then (u * (1 - p)) / ((1 - u) * p) end as q from parts),
orders as (select *, case when p > 0 then q / (1 + q) end as r from odds),
needs as (select *, target - sum(size * whole) over (partition by source) as need from orders),
runs as (
  select *, sum(size) over (partition by source, r, k, size) as tied,
    sum(size) over (partition by source order by r, k, size range between unbounded preceding and current row)
    - sum(size) over (partition by source, r, k, size) as start
  from needs where p > 0),
picked as (
  select doc_id, source, k, size, start < need and tied <= 2 * (need - start) as yes from runs)
select n.doc_id, n.size, n.source_size, n.target,
  cast(n.size * (n.whole + case when exists (select 1 from picked c where c.yes and c.k = n.k and c.size = n.size and c.source is not distinct from n.source) then 1 else 0 end) as bigint) as taken
from needs n
"""


@query("op10_pareto_mix", _SQL)
def op10_pareto_mix(spark, sf_dir):
    mixed = pareto_mix.mix(documents(spark, sf_dir))
    return mixed.selectExpr(
        "doc_id", "mix_size as size", "mix_source_size as source_size", "mix_target as target", "mix_taken as taken"
    )
