"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.llm import pu_quality
from contactlake.llm.registry import documents, query

THRESHOLD = 0.3


@query("op5_pu_quality")
def op5_pu_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = pu_quality.score_quality(documents(spark, sf_dir), labels)
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
