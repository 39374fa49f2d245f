"""All registered queries over the given tables, and their SQL."""

from __future__ import annotations

from docquarry.plans import asking, indexed, live, search, tenancy, texts

QUERIES = search.QUERIES | asking.QUERIES | texts.QUERIES | tenancy.QUERIES | live.QUERIES | indexed.QUERIES
ORACLE_SQL = search.ORACLE_SQL | asking.ORACLE_SQL | texts.ORACLE_SQL | tenancy.ORACLE_SQL | live.ORACLE_SQL | indexed.ORACLE_SQL
