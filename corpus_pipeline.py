"""The corpus pipeline: five stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
written as Parquet in the shared folder and read again by the next one.  Columns
that are not named here pass through, whatever their names.  Null texts are
empty texts; an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.llm import line_runs, pareto_mix, robust_rules, sentence_pieces, simhash_vp
from contactlake.llm.common import Guarded, materialise

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    held = Guarded(docs)
    judged = robust_rules.judge(
        held.rows, text_col=held.name("text"), lang_col=held.name("lang"), source_col=held.name("source")
    )
    return held.restore(judged.where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many documents share; n_chars follows."""
    held = Guarded(docs)
    kept = line_runs.drop_common_lines(held.rows, id_col=held.name("doc_id"), text_col=held.name("text"))
    text = F.col("kept_text")
    replaced = {"text": text, "n_chars": F.length(text).cast("long")}
    return held.restore(kept, replaced={c: v for c, v in replaced.items() if c in held.names})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id."""
    return simhash_vp.one_per_class(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    held = Guarded(docs)
    mixed = pareto_mix.mix(
        held.rows, id_col=held.name("doc_id"), text_col=held.name("text"), source_col=held.name("source")
    )
    return held.restore(pareto_mix.copies(mixed, held.rows.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with input_ids, n_tokens and what the checks of the encoding found."""
    return sentence_pieces.encode(docs, MODEL)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

# Fingerprint classes, robust estimates and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
