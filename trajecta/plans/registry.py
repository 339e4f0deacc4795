"""Queries and SQL oracles of the engine's own operators, by name."""

from __future__ import annotations

from trajecta.plans import event_queries, record_queries, run_queries, state_queries, text_queries

_ALL = [event_queries.registry, text_queries.registry, run_queries.registry, state_queries.registry, record_queries.registry]
QUERIES: dict = {k: v for r in _ALL for k, v in r.queries.items()}
ORACLES: dict = {k: v for r in _ALL for k, v in r.oracles.items()}
