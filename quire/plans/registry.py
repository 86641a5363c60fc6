"""All queries of the library (without the subpackage for training data) and the SQL that they are held against."""

from __future__ import annotations

from quire.plans import flows, gates, page, relations, roles, structure, text, upkeep

_ALL = (text.plans, relations.plans, structure.plans, upkeep.plans, flows.plans, page.plans, roles.plans, gates.plans)


def queries() -> dict:
    return {name: f for p in _ALL for name, f in p.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for p in _ALL for name, sql in p.sql.items()}
