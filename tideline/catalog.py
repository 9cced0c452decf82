"""The registered queries and their SQL, gathered from the modules of tideline.plans."""

from __future__ import annotations

from tideline.plans import attribution, data, mining, reports

MODULES = (mining, attribution, reports, data)


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
