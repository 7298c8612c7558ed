"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from . import queries_eval, queries_retrieval, queries_spans, queries_text

_PARTS = (queries_text, queries_retrieval, queries_spans, queries_eval)
QUERIES: dict = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
