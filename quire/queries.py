"""All queries of the core and their SQL."""

from __future__ import annotations

from quire import hierarchy_queries
from quire.plans import audit_queries, chapter_queries, contents_queries, document_queries, structure_queries, term_queries

_MODULES = (hierarchy_queries, audit_queries, structure_queries, term_queries, document_queries, contents_queries, chapter_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
