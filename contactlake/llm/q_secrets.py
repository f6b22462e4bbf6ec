"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactlake.llm import secret_scan
from contactlake.llm.registry import documents, query


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    found = secret_scan.scan_secrets(documents(spark, sf_dir), keep=["doc_id"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select(
        "doc_id", *[count(kind) for kind in secret_scan.BASE],
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )
