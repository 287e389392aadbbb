"""All registered queries and their SQL."""

from __future__ import annotations

from quaero.plans import data, evidence, retrieval

QUERIES = retrieval.QUERIES | data.QUERIES | evidence.QUERIES
SQL = retrieval.SQL | data.SQL | evidence.SQL
