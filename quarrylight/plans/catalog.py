"""All registered queries of the core package, with their SQL where it exists."""

from __future__ import annotations

from quarrylight.plans import answering, data_quality, evaluation, ingest, retrieval, runs, sinks

FLAGSHIP = "hybrid_search"
_PARTS = [retrieval, answering, evaluation, runs, ingest, sinks, data_quality]
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL: dict[str, str] = {name: s for part in _PARTS for name, s in part.SQL.items()}
