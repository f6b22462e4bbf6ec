"""Query of the document fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.llm import syncmers
from contactlake.llm.registry import documents, query


@query("op3_syncmers")
def op3_syncmers(spark, sf_dir):
    edits = syncmers.half_edits(documents(spark, sf_dir))
    return edits.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.printed(F.col("sketch")).alias("fingerprint"),
        syncmers.printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        syncmers.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
