"""Query of the SimHash near-dedup."""

from __future__ import annotations

from contactlake.llm import simhash_vp
from contactlake.llm.registry import documents, query


@query("op4_simhash_vp")
def op4_simhash_vp(spark, sf_dir):
    return simhash_vp.near_classes(documents(spark, sf_dir)).selectExpr(
        "__id as doc_id", "lpad(lower(hex(__fp)), 16, '0') as fingerprint", "__class as component_id"
    )
