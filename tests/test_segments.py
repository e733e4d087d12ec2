import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import plotdata, segments

XY = ["x", "y"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centres = [(0, 0), (10, 0), (0, 10), (10, 10), (5, 20)]
    rows = [(i * 60 + j, float(cx + dx), float(cy + dy)) for i, (cx, cy) in enumerate(centres) for j, (dx, dy) in enumerate(rng.normal(0, 0.6, (60, 2)))]
    return spark.createDataFrame(rows, "id int, x double, y double").cache()


def test_equally_near_centroids_give_the_lower_number(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    row = segments.assign_clusters(df, XY, [(1, 0), (-1, 0), (0, 3)]).first()
    assert row["cluster"] == 0 and row["sq_dist"] == 1.0


def test_assignment_is_a_row_expression(blobs):
    plan = segments.assign_clusters(blobs, XY, [(0, 0), (5, 5)])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_fit_properties(blobs):
    centroids = segments.fit_segments(blobs, XY, k=5, seed=0)
    assert centroids == sorted(centroids) and len(centroids) == 5
    assigned = segments.assign_clusters(blobs, XY, centroids)
    means = {r["cluster"]: (r["n"], r["mean_x"], r["mean_y"]) for r in segments.centroid_means(assigned, XY).collect()}
    assert sum(n for n, _, _ in means.values()) == 300
    for i, c in enumerate(centroids):
        assert means[i][1:] == pytest.approx(tuple(c), abs=0.05)
    cost = segments.wcss(assigned).first()["wcss"]
    data = np.array([(r["x"], r["y"]) for r in blobs.collect()])
    nearest = ((data[:, None, :] - np.array(centroids)[None]) ** 2).sum(-1).min(1)
    assert cost == pytest.approx(nearest.sum())


def test_elbow_falls_and_starts_with_the_closed_form(blobs):
    table = {r["k"]: r["wcss"] for r in segments.elbow(blobs, XY, k_max=6).collect()}
    assert sorted(table) == [1, 2, 3, 4, 5, 6]
    data = np.array([(r["x"], r["y"]) for r in blobs.collect()])
    assert table[1] == pytest.approx(((data - data.mean(0)) ** 2).sum())
    assert all(table[k + 1] <= table[k] * 1.02 for k in range(1, 6))


def test_lloyd_equals_numpy_and_keeps_an_empty_cluster(blobs):
    start = [[1.0, 1.0], [8.0, 8.0], [500.0, 500.0]]
    got = segments.lloyd(blobs, XY, start, steps=3)
    data = np.array([(r["x"], r["y"]) for r in blobs.collect()])
    want = np.array(start)
    for _ in range(3):
        label = ((data[:, None, :] - want[None]) ** 2).sum(-1).argmin(1)
        want = np.array([data[label == i].mean(0) if (label == i).any() else want[i] for i in range(3)])
    assert np.array(got) == pytest.approx(want)
    assert got[2] == [500.0, 500.0]


def test_profile_and_bins(blobs):
    assigned = segments.assign_clusters(blobs, XY, [(0, 0), (10, 0), (0, 10), (10, 10), (5, 20)])
    profile = {r["cluster"]: r for r in segments.segment_profile(assigned, XY).collect()}
    assert profile[0]["persona"] == "Low x / Low y" and profile[3]["persona"] == "High x / High y"
    assert sum(r["n"] for r in profile.values()) == 300
    table = plotdata.cluster_bins(assigned, XY, (1.0, 1.0), [(0, 0), (1, 1)])
    assert table.where("kind = 'cell'").agg(F.sum("n")).first()[0] == 300
    assert table.where("kind = 'centroid'").count() == 2
    assert segments.cluster_members(assigned, 4).count() == 60


def test_array_features(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(3 * (i % 3), 0.1, size=8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    model = segments.fit_vector_segments(df, "embedding", 3)
    assert sorted(model.summary.clusterSizes) == [20, 20, 20]


def test_sweep_equals_separate_fits_in_numpy_and_repeats(spark, blobs):
    """All k at once, from starts that do not depend on how rows are dealt; rows with a missing feature are left out."""
    odd = spark.createDataFrame([(900, None, 1.0), (901, float("nan"), 2.0)], "id int, x double, y double")
    df = blobs.unionByName(odd)
    got = segments.sweep(df, XY, [1, 2, 4, 7], seed=3, key=F.col("id"))
    again = segments.sweep(df.repartition(7), XY, [7, 4], seed=3, key=F.col("id"))
    assert all(np.allclose(again[k][0], got[k][0]) for k in again)
    data = np.array([(r["x"], r["y"]) for r in blobs.collect()])
    limit = np.sqrt(1e-4 * data.var(axis=0).mean())
    starts = segments._starts(blobs.withColumn("_hash", F.md5(F.concat_ws(":", F.lit("3"), F.col("id")))), XY, 7)
    for k, (centres, cost) in got.items():
        want = starts[:k].copy()
        for _ in range(300):
            label = ((data[:, None, :] - want[None]) ** 2).sum(-1).argmin(1)
            moved = np.array([data[label == i].mean(0) if (label == i).any() else want[i] for i in range(k)])
            step, want = np.sqrt(((moved - want) ** 2).sum(1)).max(), moved
            if step <= limit:
                break
        assert np.allclose(centres, want)
        assert cost == pytest.approx(((data[:, None, :] - want[None]) ** 2).sum(-1).min(1).sum())


def test_sweep_of_more_clusters_than_rows_and_of_none(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 1.0)], "x double, y double")
    centres, cost = segments.sweep(df, XY, [3])[3]
    assert centres == [[0.0, 1.0]] * 3 and cost == 0
    with pytest.raises(ValueError):
        segments.sweep(df.limit(0), XY, [2])
