"""Clustering of customers: assignment, cost, centroids, profile, sweep."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

Centroids = Sequence[Sequence[float]]
SAMPLE = 1024  # rows drawn by hash among which a fit finds its start
CHUNK = 8192  # rows measured against all centroids at once


def _squared_distance(features: Sequence[str], centroid: Sequence[float]) -> Column:
    terms = [(F.col(f) - F.lit(float(c))) * (F.col(f) - F.lit(float(c))) for f, c in zip(features, centroid, strict=True)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def assign_clusters(df: DataFrame, features: Sequence[str], centroids: Centroids) -> DataFrame:
    """Add `cluster` and `sq_dist` of the nearest centroid; of two equally near the lower number.

    The k centroids are literals of one row expression: no join and no shuffle.
    """
    options = [F.struct(_squared_distance(features, c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centroids)]
    nearest = df.withColumn("_near", F.array_min(F.array(*options)))
    return nearest.withColumns({"cluster": F.col("_near.c"), "sq_dist": F.col("_near.d")}).drop("_near")


def wcss(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("sq_dist").alias("wcss"), F.count(F.lit(1)).alias("n"))


def centroid_means(assigned: DataFrame, features: Sequence[str]) -> DataFrame:
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"mean_{f}") for f in features]
    )


def cluster_members(assigned: DataFrame, cluster: int) -> DataFrame:
    return assigned.where(F.col("cluster") == cluster)


def segment_profile(assigned: DataFrame, features: Sequence[str]) -> DataFrame:
    """Size, spread and a High/Low name per cluster: centroid against the mean of all rows.

    The overall mean comes from the per-cluster sums, so the rows are read once.
    """
    stats = [F.count(F.lit(1)).alias("n")]
    for f in features:
        stats += [
            F.avg(f).alias(f"mean_{f}"),
            F.stddev_samp(f).alias(f"std_{f}"),
            F.min(f).alias(f"min_{f}"),
            F.max(f).alias(f"max_{f}"),
            F.sum(f).alias(f"sum_{f}"),
        ]
    per_cluster = assigned.groupBy("cluster").agg(*stats)
    totals = per_cluster.agg(
        F.collect_list(F.struct(*per_cluster.columns)).alias("rows"),
        *[(F.sum(f"sum_{f}") / F.sum("n")).alias(f"all_{f}") for f in features],
    )
    named = totals.select(F.inline("rows"), *[f"all_{f}" for f in features])
    words = [
        F.concat(F.when(F.col(f"mean_{f}") >= F.col(f"all_{f}"), "High ").otherwise("Low "), F.lit(f))
        for f in features
    ]
    keep = [c for c in per_cluster.columns if not c.startswith("sum_")]
    return named.select(*keep, F.concat_ws(" / ", *words).alias("persona"))


def single_cluster_cost(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Cost of k = 1 in closed form: n times the sum of the population variances."""
    spread = sum((F.var_pop(f) for f in features), F.lit(0.0))
    return df.agg(F.lit(1).alias("k"), (F.count(F.lit(1)) * spread).alias("wcss"))


def lloyd(df: DataFrame, features: Sequence[str], centroids: Centroids, steps: int) -> list[list[float]]:
    """Centroids after a number of assign-and-average steps; an empty cluster keeps its place.

    Each step is one aggregate with map-side combining. The k new centroids are all that
    reaches the driver, and they enter the next step as literals, so no lineage builds up.
    """
    current = [[float(v) for v in c] for c in centroids]
    points = df.select(*features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(steps):
            means = centroid_means(assign_clusters(points, features, current), features).collect()
            for row in means:
                current[row["cluster"]] = [row[f"mean_{f}"] for f in features]
    finally:
        points.unpersist()
    return current


def _step_limit(df: DataFrame, features: Sequence[str], tol: float) -> float:
    """Centroid step below which a fit has settled: `tol` is relative to the spread of the features."""
    spread = df.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    return math.sqrt(tol * sum((v or 0.0) for v in spread) / len(features))


def _moved(features: Sequence[str], sweeps: Mapping[int, np.ndarray]):
    """Per k and cluster of a batch: rows, sums of the features and cost, from whole arrays at once."""
    names = ["k", "cluster", "n", *features, "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1)
            for at in range(0, len(x), CHUNK):
                part = x[at : at + CHUNK]
                rows = []
                for k, centres in sweeps.items():
                    apart = ((part[:, None, :] - centres[None]) ** 2).sum(axis=2)
                    nearest = apart.argmin(axis=1)  # of equals the first
                    cost = np.bincount(nearest, apart[np.arange(len(part)), nearest], k)
                    n = np.bincount(nearest, minlength=k)
                    sums = [np.bincount(nearest, part[:, f], k) for f in range(len(features))]
                    rows += [(k, c, int(n[c]), *(float(v[c]) for v in sums), float(cost[c])) for c in np.flatnonzero(n).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows, strict=True)], names)

    return run


def _totals(points: DataFrame, features: Sequence[str], sweeps: Mapping[int, np.ndarray]) -> list[Row]:
    """One row per k and cluster that has members: the only thing that reaches the driver."""
    schema = "k long, cluster long, n long, " + ", ".join(f"`{f}` double" for f in features) + ", cost double"
    parts = points.mapInArrow(_moved(features, sweeps), schema)
    return parts.groupBy("k", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", *features, "cost")]).collect()


def _starts(points: DataFrame, features: Sequence[str], k_max: int) -> np.ndarray:
    """Centroids to set off with, those of a smaller k first: of `SAMPLE` rows drawn by hash, each the farthest from all before it."""
    drawn = points.orderBy("_hash", *features).limit(SAMPLE).select(*features).collect()
    x = np.array(drawn, dtype=float).reshape(-1, len(features))
    if not len(x):
        raise ValueError("no row has all features")
    chosen = [0]
    apart = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < k_max:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def sweep(
    df: DataFrame,
    features: Sequence[str],
    ks: Sequence[int],
    seed: int = 0,
    max_iter: int = 300,
    tol: float = 1e-4,
    key: Column | None = None,
) -> dict[int, tuple[list[list[float]], float]]:
    """{k: (centroids, cost)}: k-means for several k at once, one job per iteration for all of them.

    Rows in which a feature is NULL or NaN are left out. The start is drawn by a hash of `key`
    (the features themselves unless given) and the seed, so a fit repeats exactly. A k rests as
    soon as none of its centroids moved further than the step limit; an empty cluster keeps its
    place. The cost belongs to the centroids returned.
    """
    parts = [F.lit(str(seed)), *([key] if key is not None else [F.col(f) for f in features])]
    values = [F.col(f).cast("double").alias(f) for f in features]
    points = df.select(*values, F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])).alias("_hash"))
    for f in features:
        points = points.where(F.col(f).isNotNull() & ~F.isnan(f))
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        limit = _step_limit(points, features, tol)
        first = _starts(points, features, max(ks))
        centres = {k: first[:k].copy() for k in ks}
        moving = set(ks)
        plain = points.select(*features)
        for _ in range(max_iter):
            before = {k: centres[k].copy() for k in moving}
            for r in _totals(plain, features, before):
                centres[r["k"]][r["cluster"]] = [r[f] / r["n"] for f in features]
            moving = {k for k in moving if np.sqrt(((centres[k] - before[k]) ** 2).sum(axis=1)).max() > limit}
            if not moving:
                break
        costs = dict.fromkeys(ks, 0.0)
        for r in _totals(plain, features, centres):
            costs[r["k"]] += r["cost"]
    finally:
        points.unpersist()
    return {k: (centres[k].tolist(), costs[k]) for k in ks}


def fit_segments(
    df: DataFrame,
    features: Sequence[str],
    k: int = 5,
    seed: int = 0,
    max_iter: int = 300,
    tol: float = 1e-4,
    key: Column | None = None,
) -> list[list[float]]:
    """Fitted centroids in ascending order, so that cluster numbers do not depend on the start's order."""
    return sorted(sweep(df, features, [k], seed, max_iter, tol, key)[k][0])


def segments(df: DataFrame, features: Sequence[str], k: int = 5, seed: int = 0, key: Column | None = None) -> DataFrame:
    """Fit, then every row with its cluster."""
    return assign_clusters(df, features, fit_segments(df, features, k, seed, key=key))


def elbow(
    df: DataFrame,
    features: Sequence[str],
    k_max: int = 10,
    seed: int = 42,
    max_iter: int = 300,
    tol: float = 1e-4,
    key: Column | None = None,
) -> DataFrame:
    """(k, wcss) for k = 1 .. k_max, all fitted by one `sweep`."""
    fits = sweep(df, features, range(1, k_max + 1), seed, max_iter, tol, key)
    return df.sparkSession.createDataFrame([(k, cost) for k, (_, cost) in sorted(fits.items())], "k int, wcss double")


def fit_vector_segments(df: DataFrame, array_column: str, k: int, seed: int = 0, max_iter: int = 100):
    """k-means model on an array column, for features of many dimensions."""
    from pyspark.ml.functions import array_to_vector

    vectors = df.select(array_to_vector(F.col(array_column).cast("array<double>")).alias("features"))
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return KMeans(k=k, seed=seed, initMode="k-means||", maxIter=max_iter, tol=1e-4).fit(vectors)
    finally:
        vectors.unpersist()
