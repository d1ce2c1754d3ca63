"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import oracles, queries

QUERIES = queries.QUERIES
ORACLES = oracles.ORACLES
FLAGSHIP = queries.seen_savings
