"""All queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("queries_text", "queries_models", "queries_tokens", "queries_near", "queries_words")


def _loaded():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _loaded() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _loaded() for k, q in m.ORACLES.items()}
