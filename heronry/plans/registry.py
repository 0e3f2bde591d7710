"""All queries of the library, and their SQL."""

from __future__ import annotations

from heronry.plans import imports, indexed, queries

QUERIES = queries.QUERIES | indexed.QUERIES | imports.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | indexed.ORACLE_SQL | imports.ORACLE_SQL
