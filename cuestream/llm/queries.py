"""The queries of this subpackage and, where SQL can express one, its twin."""

from __future__ import annotations

from cuestream.llm import chat_format, decontamination, language_id, near_dedup, packing, quality, sharding, substring_dedup, token_counts, topk_search

MODULES = (token_counts, language_id, near_dedup, packing, chat_format, sharding, decontamination, quality, substring_dedup, topk_search)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
