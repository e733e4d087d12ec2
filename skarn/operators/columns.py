"""Projections, predicates, counts and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators.profile import numeric_columns


def project_positional(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    return df.select(*[df.columns[i] for i in positions])


def project_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep})


def row_at(df: DataFrame, key: str, position: int) -> DataFrame:
    """The row at a 0-based position in key order: a top-k of position + 1 rows, no numbering."""
    return df.orderBy(key).offset(position).limit(1)


def open_interval(df: DataFrame, column: str, after: object, before: object) -> DataFrame:
    """Both ends excluded."""
    return df.where((F.col(column) > F.lit(after)) & (F.col(column) < F.lit(before)))


def closed_interval(df: DataFrame, column: str, first: object, last: object) -> DataFrame:
    """Both ends included."""
    return df.where(F.col(column).between(F.lit(first), F.lit(last)))


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value in value order, NULL left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(column)


def mean_by(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def last_wins(df: DataFrame, key: str, order: str | Sequence[str]) -> DataFrame:
    """One whole row per key, the last by `order`. Reduced on the map side, so a hot key is cheap."""
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*df.columns)


def to_rows(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "key", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def to_columns(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "key", value: str = "value"
) -> DataFrame:
    """Inverse of `to_rows`. The value list is given, so no pass over the data finds it out."""
    return df.groupBy(*ids).pivot(name, list(values)).agg(F.first(value))


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps, the right one wins."""
    kept = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)
