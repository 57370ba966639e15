"""Shared reading of measured records from a points table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_measured() -> Column:
    """A record has a measured position: three finite coordinates that are not all zero."""
    x, y, z = (F.col(c) for c in "xyz")
    inf = float("inf")
    finite = F.lit(True)
    for c in (x, y, z):
        finite = finite & c.isNotNull() & ~F.isnan(c) & (c > -inf) & (c < inf)
    return finite & ~((x == 0) & (y == 0) & (z == 0))


def measured(points: DataFrame, *extra: str) -> DataFrame:
    """The measured records, reduced to the columns that count; null keys are left out.

    A record sent again under the same idx has the same position and label, so the copies meet in
    whatever group the position chooses, and are dropped there.
    """
    return points.select("idx", "cloud_id", "x", "y", "z", *extra).where(
        F.col("idx").isNotNull() & F.col("cloud_id").isNotNull() & is_measured()
    )
