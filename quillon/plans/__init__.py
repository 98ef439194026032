"""Named queries of the library over the driver's tables, with their SQL."""

from __future__ import annotations

from . import cases, composed, contracts, domains, relational, retrieval, rulebook, texts

_MODULES = (retrieval, texts, rulebook, contracts, relational, domains, cases, composed)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.R.sql.items()}
