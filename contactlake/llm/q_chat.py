"""Query of the chat formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.llm import chat_events
from contactlake.llm.registry import query

# A conversation that holds control strings of the template and of others.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    return turns.unionByName(extra)


@query("op6_chat_events")
def op6_chat_events(spark, sf_dir):
    log = chat_events.turns_to_events(conversations(spark, sf_dir))
    return chat_events.read_back(chat_events.format_chats(log))
