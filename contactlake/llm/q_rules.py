"""Query of the quality rules."""

from __future__ import annotations

from contactlake.llm import robust_rules
from contactlake.llm.registry import documents, query


@query("op7_robust_rules")
def op7_robust_rules(spark, sf_dir):
    return robust_rules.judge(documents(spark, sf_dir), keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
