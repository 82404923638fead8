"""All queries of the analytics, and their SQL."""

from __future__ import annotations

from . import base, features, models, relational, scalars  # noqa: F401  they list their queries


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
