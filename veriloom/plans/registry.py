"""All queries of the core, and their SQL."""

from __future__ import annotations

from veriloom.plans import answer_queries, breadth_queries, nested, record_queries, rl_queries, source_queries

_PARTS = (answer_queries, record_queries, rl_queries, source_queries, nested, breadth_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLE.items()}
