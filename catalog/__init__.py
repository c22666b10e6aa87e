"""Registered queries: every operator applied to whole tables, with oracle SQL beside it."""

from __future__ import annotations

import importlib

_MODULES = ("q_sources", "q_functions", "q_diff", "q_checks", "q_rules", "q_report", "q_history",
            "q_suite")


def _merged(attribute: str) -> dict:
    merged = {}
    for name in _MODULES:
        merged.update(getattr(importlib.import_module(f"catalog.{name}"), attribute))
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
