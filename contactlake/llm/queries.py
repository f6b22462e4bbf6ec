"""Loads every query of this subpackage."""

from __future__ import annotations

from contactlake.llm import q_chat, q_embeddings, q_lines, q_mix, q_pieces, q_quality, q_rules, q_secrets, q_simhash, q_syncmers, q_trie, q_warc  # noqa: F401
from contactlake.llm.registry import ORACLE, QUERIES  # noqa: F401
