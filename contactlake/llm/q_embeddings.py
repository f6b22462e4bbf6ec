"""Queries over embedding tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.llm import embedding_hnsw, hard_negatives
from contactlake.llm.registry import query

_SQL = """
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as lab,
    list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pos as (
  select * from (
    select a.vec_id as anchor_id, a.lab, a.e, b.vec_id as positive_id, list_dot_product(a.e, b.e)::bigint as positive_score,
      row_number() over (partition by a.vec_id order by list_dot_product(a.e, b.e) desc, b.vec_id) as n
    from v a join v b on b.lab = a.lab and b.vec_id <> a.vec_id where a.vec_id % 100 = 0)
  where n <= 5),
neg as (
  select anchor_id, positive_id, positive_score, v.vec_id as negative_id, list_dot_product(pos.e, v.e)::bigint as negative_score
  from pos join v on v.lab <> pos.lab),
ranked as (
  select *, row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id)::int as rank
  from neg where 30 * positive_score <= 100 * negative_score and 100 * negative_score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""


def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query("op13_embedding_hnsw")
def op13_embedding_hnsw(spark, sf_dir):
    return embedding_hnsw.near_vectors(embeddings(spark, sf_dir))


@query("op11_hard_negatives", _SQL)
def op11_hard_negatives(spark, sf_dir):
    label = F.col("label").cast("long")
    moved = embeddings(spark, sf_dir).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(moved, F.col("vec_id") % 100 == 0)
