"""All queries of the core with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointspark.plans import problems, reference

_PARTS = (reference, problems)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for p in _PARTS for k, q in p.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for p in _PARTS for k, q in p.oracle_sql().items()}
