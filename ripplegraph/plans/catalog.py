"""All registered queries and oracles of the engine."""

from __future__ import annotations

from . import ingest_queries, link_queries, reach_queries

QUERIES = {**reach_queries.QUERIES, **link_queries.QUERIES, **ingest_queries.QUERIES}
ORACLES = {**reach_queries.ORACLES, **link_queries.ORACLES, **ingest_queries.ORACLES}
