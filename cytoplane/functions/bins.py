"""Binning of values between two clip limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE_BINS = 256


def value_bin(value: Column, low: Column, high: Column, bins: int = VALUE_BINS) -> Column:
    """Bin index of a value, clipped to [low, high]; a flat range puts all in the middle bin."""
    scaled = F.try_divide(value - low, high - low)
    clipped = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))
    return F.when(high <= low, F.lit(min(bins // 2, bins - 1)).cast("bigint")).otherwise(
        F.floor(clipped * F.lit(float(bins - 1)))
    )
