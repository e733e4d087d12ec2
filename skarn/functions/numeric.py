"""Scaling, softmax and missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType


def missing(column: Column, dtype: DataType) -> Column:
    """NULL, or NaN in a floating column."""
    if isinstance(dtype, (DoubleType, FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def softmax(logits: Column) -> Column:
    """Softmax of an array column, shifted by its largest entry so that exp cannot overflow."""
    powers = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(powers, lambda v: v / total)


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """A series without spread is only centred."""
    return (value - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def inverse_zscore(value: Column, mean: Column, std: Column) -> Column:
    return value * F.when(std == 0, F.lit(1.0)).otherwise(std) + mean


def minmax(value: Column, low: Column, high: Column) -> Column:
    """A series without spread goes to 0."""
    return F.when(high == low, F.lit(0.0)).otherwise((value - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low))


def bin_index(value: Column, low: float, width: float) -> Column:
    """0-based number of the bin of the given width that holds the value."""
    return F.floor((value - low) / width).cast("long")
