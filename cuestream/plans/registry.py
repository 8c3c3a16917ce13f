"""All queries on the engine's own operators, with their SQL twins."""

from __future__ import annotations

from cuestream.plans import cue_queries, job_queries, record_queries, repair_queries, run_queries, stream_queries, text_queries

MODULES = (run_queries, cue_queries, job_queries, text_queries, stream_queries, repair_queries, record_queries)
QUERIES = {name: query for module in MODULES for name, (query, _) in module.TWINS.items()}
ORACLES = {name: sql for module in MODULES for name, (_, sql) in module.TWINS.items() if sql}
