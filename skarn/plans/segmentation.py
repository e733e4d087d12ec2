"""Customer segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators import plotdata, segments
from skarn.sources import views

FEATURES = ["income", "spend"]

# Fixed starting centroids of the deterministic queries: (income, spend).
START = [(1000.0, 500.0), (1500.0, 3500.0), (4500.0, 1500.0), (8000.0, 700.0), (8500.0, 3000.0)]


def _assigned(spark, sf_dir):
    return segments.assign_clusters(views.customers(spark, sf_dir), FEATURES, START)


def assign_fixed_centroids(spark, sf_dir):
    return _assigned(spark, sf_dir).select("id", "cluster", F.round("sq_dist", 3).alias("sq_dist"))


def wcss_fixed_centroids(spark, sf_dir):
    return segments.wcss(_assigned(spark, sf_dir)).withColumn("wcss", F.round("wcss", 1))


def centroid_means(spark, sf_dir):
    means = segments.centroid_means(_assigned(spark, sf_dir), FEATURES)
    return means.withColumns({f"mean_{f}": F.round(f"mean_{f}", 5) for f in FEATURES})


def cluster_members(spark, sf_dir):
    members = segments.cluster_members(_assigned(spark, sf_dir), 1)
    return members.select("id", "cluster", *FEATURES)


def segment_profile(spark, sf_dir):
    out = segments.segment_profile(_assigned(spark, sf_dir), FEATURES)
    return out.withColumns({f"{s}_{f}": F.round(f"{s}_{f}", 5) for s in ("mean", "std") for f in FEATURES})


def cluster_bins(spark, sf_dir):
    return plotdata.cluster_bins(_assigned(spark, sf_dir), FEATURES, (500.0, 250.0), START)


def elbow_k1(spark, sf_dir):
    out = segments.single_cluster_cost(views.customers(spark, sf_dir), FEATURES)
    return out.withColumn("wcss", F.round("wcss", 1))


def kmeans_lloyd_3(spark, sf_dir):
    people = views.customers(spark, sf_dir)
    centroids = segments.lloyd(people, FEATURES, START, steps=3)
    assigned = segments.assign_clusters(people, FEATURES, centroids)
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(f), 4).alias(f"mean_{f}") for f in FEATURES],
        F.round(F.sum("sq_dist"), 1).alias("wcss"),
    )


def kmeans_segments(spark, sf_dir):
    people = views.customers(spark, sf_dir)
    return segments.segments(people, FEATURES, k=5, seed=0, key=F.col("id")).select("id", *FEATURES, "cluster")


def kmeans_elbow(spark, sf_dir):
    out = segments.elbow(views.customers(spark, sf_dir), FEATURES, k_max=10, seed=42, key=F.col("id"))
    return out.withColumn("wcss", F.round("wcss", -2))


QUERIES = {
    f.__name__: f
    for f in (
        assign_fixed_centroids,
        wcss_fixed_centroids,
        centroid_means,
        cluster_members,
        segment_profile,
        cluster_bins,
        elbow_k1,
        kmeans_lloyd_3,
        kmeans_segments,
        kmeans_elbow,
    )
}
