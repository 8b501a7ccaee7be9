"""Every query over the test tables and the SQL each is held against."""

from __future__ import annotations

from folioflow.queries import documents, indexes, operations, retrieval
from folioflow.queries.retrieval import hybrid_search_filtered

__all__ = ["QUERIES", "SQL", "hybrid_search_filtered"]

QUERIES = retrieval.QUERIES | documents.QUERIES | operations.QUERIES | indexes.QUERIES
SQL = retrieval.SQL | documents.SQL | operations.SQL | indexes.SQL
