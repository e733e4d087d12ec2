"""Bounded tables behind the usual charts: 2-D bins and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.numeric import bin_index
from skarn.operators.segments import Centroids


def cluster_bins(
    assigned: DataFrame, features: Sequence[str], widths: Sequence[float], centroids: Centroids
) -> DataFrame:
    """(kind, cluster, x, y, n): points counted per cell, and the centroids themselves."""
    (fx, fy), (wx, wy) = features, widths
    cells = (
        assigned.groupBy(
            "cluster", F.floor(F.col(fx) / wx).cast("long").alias("bx"), F.floor(F.col(fy) / wy).cast("long").alias("by")
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("cell").alias("kind"), "cluster", (F.col("bx") * wx).alias("x"), (F.col("by") * wy).alias("y"), "n")
    )
    marks = F.array(
        *[F.struct(F.lit(i).alias("cluster"), F.lit(float(c[0])).alias("x"), F.lit(float(c[1])).alias("y")) for i, c in enumerate(centroids)]
    )
    centres = assigned.sparkSession.range(1).select(F.inline(marks)).select(
        F.lit("centroid").alias("kind"), "cluster", "x", "y", F.lit(None).cast("long").alias("n")
    )
    return cells.unionByName(centres)


def pair_bins(df: DataFrame, group: str, columns: Sequence[str], width: float) -> DataFrame:
    """(group, a, b, bin_a, bin_b, n) for each unordered pair of columns, in one aggregate."""
    columns = list(columns)
    bins = df.where(F.col(group).isNotNull()).select(group, *[bin_index(F.col(c), 0.0, width).alias(c) for c in columns])
    # Equal rows are merged first, so that pairs are made of cells and not of rows.
    cells = bins.groupBy(group, *columns).agg(F.count(F.lit(1)).alias("c"))
    pairs = F.array(
        *[
            F.struct(
                F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"),
                F.col(columns[i]).alias("bin_a"), F.col(columns[j]).alias("bin_b"),
            )
            for i in range(len(columns))
            for j in range(i + 1, len(columns))
        ]
    )
    long = cells.select(group, "c", F.inline(pairs))
    return long.groupBy(group, "a", "b", "bin_a", "bin_b").agg(F.sum("c").alias("n"))


def histogram(df: DataFrame, group: str, columns: Sequence[str], low: float, width: float) -> DataFrame:
    """(group, variable, bin, n) per column."""
    rated = df.where(F.col(group).isNotNull())
    long = rated.select(group, *columns).unpivot([group], list(columns), "variable", "value")
    binned = long.where(F.col("value").isNotNull()).withColumn("bin", bin_index(F.col("value"), low, width))
    return binned.groupBy(group, "variable", "bin").agg(F.count(F.lit(1)).alias("n"))
