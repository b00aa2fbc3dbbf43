"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import code_queries, markup_queries, metric_queries, planning_queries, record_queries, retrieval_queries, source_queries, structure_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (retrieval_queries, metric_queries, structure_queries, record_queries, markup_queries, code_queries, planning_queries, source_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
