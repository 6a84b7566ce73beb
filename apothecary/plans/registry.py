"""All core queries by name."""

from __future__ import annotations

from apothecary.plans import core_problems, feeds, labels, modeling, streams

MODULES = (core_problems, feeds, modeling, labels, streams)
FLAGSHIP = "available_manufacturers"


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
