"""Queries over the driver's tables, each beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from lamella.plans import events, pairs, relational, sequences  # noqa: F401  they register their queries
from lamella.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
