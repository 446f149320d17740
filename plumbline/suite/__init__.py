"""Registered queries: every operator over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

import importlib

MODULES = ["profiling", "cleaning", "exploring", "warehouse", "usage", "charting", "semantics", "governance",
           "learning", "live", "passing", "handling", "joining"]


def collect() -> dict:
    """``name -> (query, sql or None)`` over all suite modules."""
    found = {}
    for module in MODULES:
        try:
            found.update(importlib.import_module(f"plumbline.suite.{module}").QUERIES)
        except ModuleNotFoundError as missing:
            if missing.name != f"plumbline.suite.{module}":
                raise
    return found
