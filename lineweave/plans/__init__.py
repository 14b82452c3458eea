"""Registered queries over the driver's tables, each with its SQL, and planners without data."""

from __future__ import annotations


def queries() -> dict:
    from lineweave.plans.tables import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from lineweave.plans.tables import ORACLES

    return dict(ORACLES)
