"""All queries and their SQL, whatever module they are in."""

from __future__ import annotations

from caseflow.plans.model_queries import ORACLE, QUERIES
from caseflow.plans.storage_queries import ORACLE as _STORED_SQL
from caseflow.plans.storage_queries import QUERIES as _STORED

__all__ = ["ORACLE", "QUERIES"]

# The modules register into the same tables.
assert _STORED is QUERIES and _STORED_SQL is ORACLE
