"""Query of the conversation prefix trie, over conversations that share their openings."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.llm import prefix_trie
from contactlake.llm.registry import query

_SQL = r"""
with crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i::ubigint, [0::ubigint,0,0,0,0,0,0,0]),
    lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end)) as t),
turns as (
  select conv_id as c, coalesce(text, '') as text,
    md5(cast(length(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) as tid, turn
  from conversations where conv_id is not null),
own as (
  select *, row_number() over (partition by c order by turn nulls first, tid) - 1 as pos from turns),
convs as (
  select c, c - c % 100 as base, xor(list_reduce(
    list_prepend(4294967295::ubigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::ubigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::bigint + 1])), 4294967295::ubigint)::bigint % 6 as h
  from (select distinct c from own), crc),
opened as (
  select v.c, v.h, count(o.pos) as nb from convs v left join own o on o.c = v.base and o.pos < v.h group by v.c, v.h),
rebuilt as (
  select v.c, o.pos, o.tid, length(o.text) as chars from convs v join own o on o.c = v.base and o.pos < v.h
  union all
  select v.c, v.nb + o.pos - v.h, o.tid, length(o.text) from opened v join own o on o.c = v.c and o.pos >= v.h),
seqs as (
  select v.c, coalesce(list(r.tid order by r.pos) filter (where r.pos is not null), []) as tids,
    coalesce(list(r.chars order by r.pos) filter (where r.pos is not null), []) as chars
  from convs v left join rebuilt r on r.c = v.c group by v.c),
cut as (select c, tids, chars, len(tids) as n, unnest(range(0, len(tids) + 1)) as d from seqs),
member as (
  select c, n, d, array_to_string(tids[1:d], ',') as k, case when d > 0 then array_to_string(tids[1:d-1], ',') end as up,
    case when d > 0 then chars[d] else 0 end as last_chars from cut),
node as (
  select k, any_value(up) as up, any_value(d) as depth, min(c) as conv_id, count(*) as n_convs, any_value(last_chars) as chars,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where n = d), '')) as ends_sha256
  from member group by k, d),
kids as (select up, count(*) as n_children from node where up is not null group by up),
own_sums as (
  select n.*, coalesce(kids.n_children, 0) as n_children, (n_convs - 1) * chars as saved from node n left join kids on kids.up = n.k),
spread as (
  select unnest(list_transform(range(0, depth + 1), lambda a: array_to_string(string_split(k, ',')[1:a], ','))) as k,
    saved, (n_children = 0)::int as leaf from own_sums),
total as (select k, sum(leaf) as n_leaves, sum(saved) as saved_tokens from spread group by k)
select o.conv_id, o.depth::bigint as depth, p.conv_id as parent_conv_id, o.n_convs, o.n_children,
  t.n_leaves::bigint as n_leaves, t.saved_tokens::bigint as saved_tokens, o.ends_sha256
from own_sums o join total t on t.k = o.k left join node p on p.k = o.up
"""


def rebuilt(turns):
    """(turns, conversations): every conversation with the first turns of the one whose number ends in 00 before its own."""
    convs = turns.select("c").distinct().select(
        "c", (F.col("c") - F.col("c") % 100).alias("base"), (F.crc32(F.col("c").cast("string")) % 6).alias("h")
    )
    opening = turns.where("c % 100 = 0 and pos < 5")
    counts = opening.groupBy(F.col("c").alias("base")).agg(F.count("*").alias("n_base"))
    convs = convs.join(counts, "base", "left").select("c", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("opens"))
    shared = opening.withColumnRenamed("c", "base").join(convs, "base").where("pos < h").select("c", "pos", "tid", "chars")
    own = turns.join(convs, "c").where("pos >= h").select("c", (F.col("opens") + F.col("pos") - F.col("h")).alias("pos"), "tid", "chars")
    return shared.unionByName(own), convs.select("c")


@query("op12_prefix_trie", _SQL)
def op12_prefix_trie(spark, sf_dir):
    turns = prefix_trie.number_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    nodes = prefix_trie.trie(*rebuilt(turns))
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
