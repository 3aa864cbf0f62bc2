"""All registered queries: name -> callable, and name -> equivalent SQL."""

from __future__ import annotations

import importlib

FLAGSHIP = "t01_portfolio_trail_1wk"
MODULES = ["trend_queries", "kernel_queries", "intraday_queries", "risk_queries", "lifecycle_queries", "calibration_queries", "more_queries", "gate_queries", "guard_queries"]


def _all(kind: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"tidelane.plans.{module}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
