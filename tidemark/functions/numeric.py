"""Flags, coercions and small numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(col: str) -> Column:
    """Lenient number: bad text gives null."""
    return F.col(col).try_cast("double")


def true_flag(col: str) -> Column:
    """1 only where the value is known to be true."""
    return F.coalesce((F.col(col) == F.lit(True)).cast("int"), F.lit(0))


def sum_known(cols: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return total


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip that leaves null as null."""
    y = x if lo is None else F.greatest(x, F.lit(lo))
    y = y if hi is None else F.least(y, F.lit(hi))
    return F.when(x.isNotNull(), y)
