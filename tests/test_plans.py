"""Plans of the registered queries: what must be there, and what must not."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skarn.operators import filters
from skarn.sources import views

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()

# Python workers: user models, Poisson draws and the least-squares solver on one row per series.
WITH_PYTHON = {
    "model_scores", "scored_or_quarantined", "rating_ci_bootstrap", "ar3_forecast", "forecast_vs_actual", "recursive_forecast_ar3", "sequence_forecast",
}
# Fitting runs jobs of its own while the query is built.
FITTED = {"kmeans_segments", "kmeans_elbow", "kmeans_lloyd_3", "text_classifier_scores", "forecast_by_split", "window60_forecast", "boosted_forecast"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_no_cross_join_no_single_partition_of_rows_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("EvalPython" in plan) == (name in WITH_PYTHON)
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            # Only the final step of a global aggregate may gather, one row per task.
            assert "partial_" in lines[i + 1] or "Aggregate" in lines[i + 1], line


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("rating_counts", ["documents", "doc_id:bigint"]),
        ("dedup_last_wins", ["orders", "o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double"]),
        ("lag_features", ["orders", "o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string"]),
    ],
)
def test_scans_read_only_what_they_need(spark, name, columns):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert any(columns[0] in line and f"ReadSchema: struct<{columns[1]}>" in line for line in plan.splitlines())


def test_filter_reaches_the_scan(spark):
    # what asof_ticks asks with; its own plan begins at the stored range cuts
    probes = views.ticks(spark, SF_DIR).where("series_id = 'error'")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)" in plan_of(probes)
    assert "PushedFilters: [IsNotNull(_end), EqualTo(_end,true)" in plan_of(QUERIES["asof_ticks"](spark, SF_DIR))


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q.startswith("top_disagreement")))
def test_only_texts_that_may_have_the_rating_are_scored(spark, name):
    """The filter of the ids lies below the scoring, next to the scan; the exact join comes after it, without texts."""
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    lines = plan.splitlines()
    kept = next(i for i, line in enumerate(lines) if "Filter" in line and "getbit(" in line)
    assert "FileScan" in lines[kept + 1] and "documents.parquet" in lines[kept + 1]
    assert not any("regexp_extract_all" in line for line in lines[kept:])  # words are cut of what is left


@pytest.mark.parametrize("bits", [None, 64])
def test_filters_let_all_members_pass(spark, bits):
    members = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    few = members.limit(3) if bits else members
    test = filters.likely_in(few.union(spark.sql("SELECT CAST(NULL AS BIGINT)")), "k", bits)
    passed = {r["id"] for r in spark.range(5000).where(test(F.col("id"))).collect()}
    assert passed >= {r["k"] for r in few.collect()} and len(passed) < 1000
    assert spark.range(9).where(filters.likely_in(members.limit(0), "k")(F.col("id"))).count() == 0
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").where(test(F.col("id"))).count() == 0


@pytest.mark.parametrize("name", ["column_profile", "null_counts"])
def test_no_text_crosses_the_join_of_a_profile(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, SF_DIR)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" in plan
    text = [line for line in plan.splitlines() if "text#" in line]
    # the column is looked at where it is read, and nowhere above
    assert all("FileScan" in line or "isnotnull(text#" in line or "isnull(text#" in line for line in text)


def test_top_rows_are_kept_on_the_map_side(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top_disagreement_1_lexicon"](spark, SF_DIR))
    assert plan_of(QUERIES["last_k_ticks"](spark, SF_DIR)).count("WindowGroupLimit") == 2
    assert plan_of(QUERIES["disagreements_per_rating"](spark, SF_DIR)).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["row_index_ticks", "lag_features_ticks", "history_windows_ticks", "asof_ticks"])
def test_single_events_are_never_ordered_by_series_alone(spark, name):
    """A window over rows runs on blocks; only the counts of the cuts go by series."""
    for line in plan_of(QUERIES[name](spark, SF_DIR)).splitlines():
        if "Window [" in line and "event_id" in line:
            assert "_block" in line, line


def test_bars_need_two_exchanges(spark):
    """One for the bars themselves, one by series for index, lags and counts together."""
    assert plan_of(QUERIES["split_chrono"](spark, SF_DIR)).count("Exchange hashpartitioning") == 2
