"""All queries of the market jobs and their SQL."""

from __future__ import annotations

from . import daily, fitting, intraday, loop, modelling, pooled, predictions

PARTS = (daily, intraday, loop, predictions, modelling, fitting, pooled)


def queries() -> dict:
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.ORACLE.items()}
