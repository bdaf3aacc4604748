"""All registered queries of the engine, by name."""

from __future__ import annotations

from evalquarry.plans import queries_columns, queries_files, queries_generations, queries_nodes, queries_runs, queries_text, queries_verbs
from evalquarry.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_columns", "queries_files", "queries_generations", "queries_nodes", "queries_runs", "queries_text", "queries_verbs"]
