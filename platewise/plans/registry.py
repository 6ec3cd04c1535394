"""All registered queries of the core."""

from __future__ import annotations

from platewise.plans import cleaning, loading, planning, profiling, recommend, scoring, streams, text

MODULES = (loading, profiling, cleaning, text, scoring, recommend, planning, streams)
FLAGSHIP = scoring.combine_topk


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def sql() -> dict:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
