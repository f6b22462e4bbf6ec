"""Query of the SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.llm import sentence_pieces
from contactlake.llm.registry import documents, query

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op2_sentence_pieces")
def op2_sentence_pieces(spark, sf_dir, model_path=MODEL):
    encoded = sentence_pieces.encode(documents(spark, sf_dir), model_path, keep=["doc_id"])
    return encoded.select(
        "doc_id", "n_tokens", F.sha2(F.array_join("input_ids", ","), 256).alias("ids_sha256"), "parity", "lossless",
        "decoded_sha256",
    )
