"""Natural join, join to per-group rows spread by salts, positional alignment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def natural_left_join(left: DataFrame, right: DataFrame, null_safe: bool = False) -> DataFrame:
    """Left outer equi-join on every column name the two frames share.

    Join strategy is left to the optimizer. With `null_safe` a NULL key matches a NULL key.
    (Spark treats NaN keys as equal to each other in any case.)
    """
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the two frames share no column name")
    if not null_safe:
        return left.join(right, on=shared, how="left")
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in shared})
    condition = reduce(
        lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_right_{c}"]) for c in shared]
    )
    return left.join(renamed, condition, "left").drop(*[f"_right_{c}" for c in shared])


def join_groups(big: DataFrame, per_group: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a big frame to a table with one row per group.

    The per-group rows are repeated over `SALTS` salts and each row of the big frame takes one of
    them, so a hot group is spread over as many tasks. The plan is the same at any size; whether
    the repeated table is small enough to broadcast is the optimizer's choice.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    return left.join(per_group.withColumn("_salt", salts), [*on, "_salt"], how).drop("_salt")


def align(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("series_id", "row_idx")) -> DataFrame:
    """Put two ordered sets side by side by position, which both carry as a column.

    The pair (series, position) is unique, so a long series spreads over all partitions.
    """
    return left.join(right, list(keys), "left")
