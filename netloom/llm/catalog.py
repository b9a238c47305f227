"""All registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from netloom.llm import problems, texts

_MODULES = (problems, texts)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
