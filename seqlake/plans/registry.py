"""Every query of the engine's own operators, with the SQL that checks it."""

from __future__ import annotations

from seqlake.plans import pairs  # noqa: F401 - registers its queries
from seqlake.plans.queries import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
