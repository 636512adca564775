"""All queries of the library by name, and the SQL that states the same result."""

from __future__ import annotations

from casewright.plans import answers, audits, decisions, gating, layouts, locking, panels, rewarding, texts, wording

FAMILIES = [decisions, answers, layouts, panels, texts, audits, gating, rewarding, locking, wording]


def queries() -> dict:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
