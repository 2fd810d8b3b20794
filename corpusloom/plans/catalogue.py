"""All queries of the engine's own operators, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

MODULES = ["keyword_queries", "similarity_queries", "structure_queries", "corpus_queries", "lexicon_queries"]


def _all(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"corpusloom.plans.{m}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
