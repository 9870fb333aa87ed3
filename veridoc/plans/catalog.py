"""All queries of the fidelity engine and their DuckDB statements."""

from __future__ import annotations

from veridoc.plans import fidelity_queries, job_queries, layout_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **layout_queries.QUERIES, **job_queries.QUERIES, **fidelity_queries.QUERIES}
ORACLE: dict[str, str] = {**text_queries.ORACLE, **layout_queries.ORACLE, **job_queries.ORACLE, **fidelity_queries.ORACLE}
