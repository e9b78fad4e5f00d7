"""All queries of the core, by name, and the SQL that states the same result."""

from __future__ import annotations

from chunkloom.plans import catalog_queries, operation_queries, problems, store_queries

QUERIES = {**problems.QUERIES, **catalog_queries.QUERIES, **operation_queries.QUERIES, **store_queries.QUERIES}
SQL = {**problems.SQL, **catalog_queries.SQL, **operation_queries.SQL, **store_queries.SQL}
