"""Edge weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.functions.geo import col, half_away


def inverse_distance(metres) -> Column:
    """1 / (1 + kilometres), from the unrounded distance, to three decimals."""
    return F.round(F.lit(1.0) / (F.lit(1.0) + col(metres) / 1000.0), 3)


def kilometres(metres) -> Column:
    return half_away(col(metres) / 1000.0, 3)


def whole_metres(metres) -> Column:
    """Nearest whole metre, halves to even."""
    return F.rint(col(metres)).cast("long")


def coupling(buffer_hours) -> Column:
    """1 / (1 + hours of buffer)."""
    return F.lit(1.0) / (F.lit(1.0) + F.coalesce(col(buffer_hours), F.lit(0.0)))
