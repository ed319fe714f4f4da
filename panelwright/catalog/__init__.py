"""All registered queries."""

from __future__ import annotations

from panelwright.catalog import bars, features, forecasts, grouped, metrics, sources  # noqa: F401
from panelwright.catalog.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
