"""Registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from prosemeter.plans import nested, readability, simplification

MODULES = (readability, simplification, nested)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
