import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skarn.operators import forecast, ranges, series
from skarn.operators.series import BARS, Layout

DAY0 = dt.date(2020, 1, 1)


def bars(spark, days, name="s", values=None):
    values = values or [float(10 + i) for i in range(len(days))]
    rows = [(name, DAY0 + dt.timedelta(days=d), v) for d, v in zip(days, values)]
    return spark.createDataFrame(rows, "series_id string, dt date, close double")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or ("series_id", "dt"))).collect()]


def test_lag_table_takes_history_from_before_the_range(spark):
    df = bars(spark, range(10))
    got = series.lag_table(df, BARS, "close", 3, DAY0 + dt.timedelta(4), DAY0 + dt.timedelta(5))
    assert [(r["lag_3"], r["lag_2"], r["lag_1"], r["target"]) for r in got.orderBy("dt").collect()] == [
        (11.0, 12.0, 13.0, 14.0),
        (12.0, 13.0, 14.0, 15.0),
    ]


def test_lag_table_starts_at_the_first_observed_date_and_always_ends(spark):
    df = bars(spark, [0, 1, 2, 5, 6])
    got = series.lag_table(df, BARS, "close", 2, DAY0 + dt.timedelta(3), DAY0 + dt.timedelta(400))
    assert [r["dt"].day for r in got.orderBy("dt").collect()] == [6, 7]


def test_short_history_is_dropped_counted_or_raised(spark):
    df = bars(spark, range(2)).unionByName(bars(spark, range(6), "t"))
    assert series.lag_table(df, BARS, "close", 3).count() == 3
    counts = {r["series_id"]: r["n_short"] for r in series.short_history(df, BARS, 3).collect()}
    assert counts == {"s": 2, "t": 3}
    with pytest.raises(ValueError):
        series.lag_table(df, BARS, "close", 3, strict=True)


def test_gap_cut(spark):
    df = bars(spark, [0, 1, 2, 9, 10, 18, 19])
    whole = series.lag_table(df, BARS, "close", 1)
    assert whole.count() == 6
    assert [r["gap_days"] for r in whole.orderBy("dt").collect()] == [1, 1, 7, 1, 8, 1]
    cut = series.lag_table(df, BARS, "close", 1, max_gap_days=7)
    assert [r["dt"] for r in cut.orderBy("dt").collect()] == [DAY0 + dt.timedelta(d) for d in (1, 2, 9, 10)]
    pieces = series.lag_table(df, Layout(block=3), "close", 1, max_gap_days=7)
    assert rows(pieces) == rows(cut)
    # The gap before the first wanted row does not end the run.
    late = series.lag_table(df, BARS, "close", 1, first=DAY0 + dt.timedelta(18), max_gap_days=7)
    assert late.count() == 2


def test_next_observation(spark):
    df = bars(spark, [0, 7, 15])
    got = rows(series.next_observation(df, BARS).select("gap_days", "within", "dt"), "dt")
    assert [r[:2] for r in got] == [(7, True), (8, False), (None, False)]


def test_history_windows(spark):
    df = bars(spark, range(8))
    got = series.history(df, BARS, "close", 3).orderBy("dt").collect()
    assert [r["window"] for r in got] == [[10.0 + i, 11.0 + i, 12.0 + i] for i in range(5)]
    lagged = {r["dt"]: r["lag_1"] for r in series.lags(df, BARS, "close", 1).collect()}
    assert all(r["window"][-1] == lagged[r["dt"]] for r in got)


def test_history_refuses_missing_values(spark):
    df = bars(spark, range(4), values=[1.0, None, 2.0, 3.0])
    with pytest.raises(Exception, match="impute"):
        series.history(df, BARS, "close", 2).collect()


@pytest.mark.parametrize("n", [1, 2, 5, 10, 20, 251])
def test_splits_cut_where_python_does(spark, n):
    df = bars(spark, range(n))
    got = [r["split"] for r in series.split_chronological(df, BARS).orderBy("dt").collect()]
    a, b = int(n * 0.8), int(n * 0.9)
    assert got == ["train"] * a + ["val"] * (b - a) + ["test"] * (n - b)
    cut = int(np.ceil(n * 0.95))
    got = [r["split"] for r in series.split_holdout(df, BARS).orderBy("dt").collect()]
    assert got == ["train"] * cut + ["test"] * (n - cut)


def test_asof_reads_the_row_at_or_before(spark):
    facts = bars(spark, [1, 3, 5])
    probes = spark.createDataFrame([("s", DAY0 + dt.timedelta(d), d) for d in (0, 1, 2, 5, 90)] + [("u", DAY0, 0)], "series_id string, dt date, tag int")
    for layout in (BARS, Layout()):
        got = rows(series.asof(probes, facts, layout, ["close"]).select("series_id", "tag", "close"), "series_id", "tag")
        assert got == [("s", 0, None), ("s", 1, 10.0), ("s", 2, 10.0), ("s", 5, 12.0), ("s", 90, 12.0), ("u", 0, None)]


def test_arrays_of_a_lag_table(spark):
    table = series.lag_table(bars(spark, range(5)), BARS, "close", 3)
    flat = series.lag_arrays(table, BARS, 3)
    assert dict(flat.dtypes)["X"] == "array<float>" and dict(flat.dtypes)["y"] == "float"
    assert flat.orderBy("dt").first()["X"] == [10.0, 11.0, 12.0]
    assert series.lag_arrays(table, BARS, 3, nested=True).orderBy("dt").first()["X"] == [[10.0], [11.0], [12.0]]


LONG = st.integers(min_value=1, max_value=120)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=LONG, back=st.integers(1, 7), block=st.integers(1, 40), seed=st.integers(0, 99))
def test_cuts_and_blocks_equal_one_window_per_series(spark, n, back, block, seed):
    rng = np.random.default_rng(seed)
    days = sorted(rng.choice(400, size=n, replace=False).tolist())
    df = bars(spark, days, "a", rng.normal(size=n).tolist()).unionByName(bars(spark, days[: n // 2 + 1], "b"))
    split = Layout(block=block)
    names = ["series_id", "dt", "row_idx", "n_rows"]
    assert rows(series.row_index(df, split).select(names)) == rows(series.row_index(df, BARS).select(names))
    names = ["series_id", "dt", *[f"lag_{k}" for k in range(back, 0, -1)], "prev_time"]
    assert rows(series.lags(df, split, "close", back).select(names)) == rows(series.lags(df, BARS, "close", back).select(names))
    names = ["series_id", "dt", "window"]
    assert rows(series.history(df, split, "close", back).select(names)) == rows(series.history(df, BARS, "close", back).select(names))
    names = ["series_id", "dt", "next_time", "within"]
    assert rows(series.next_observation(df, split).select(names)) == rows(series.next_observation(df, BARS).select(names))


def test_ties_in_time_keep_a_total_order(spark):
    data = [("s", DAY0, i, float(i)) for i in range(50)]
    df = spark.createDataFrame(data, "series_id string, dt date, id long, close double")
    layout = Layout(tie=("id",), block=7)
    got = series.lags(df, layout, "close", 2).orderBy("id").collect()
    assert [r["row_idx"] for r in got] == list(range(50))
    assert [r["lag_2"] for r in got] == [None, None, *map(float, range(48))]


@pytest.fixture
def many_cuts(spark):
    """Cuts stay as many as shuffle partitions: small ones are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot_day(spark, n, seed, names=("s",)):
    """All rows in one day, most at one instant, in no order."""
    rng = np.random.default_rng(seed)
    at = dt.datetime(2020, 1, 1, 12)
    rows = [(str(rng.choice(names)), at + dt.timedelta(seconds=int(rng.choice([0, 0, 0, rng.integers(60)]))), i, float(rng.normal())) for i in range(n)]
    return spark.createDataFrame([rows[i] for i in rng.permutation(n)], "series_id string, ts timestamp_ntz, event_id long, value double")


EVENTS = Layout(time="ts", tie=("event_id",), block=50)


def test_one_day_of_one_series_spreads_over_all_cuts(spark, many_cuts):
    df = hot_day(spark, 4000, 1)
    sizes = [r["count"] for r in ranges.ranged(df, ["series_id", *EVENTS.order]).groupBy("_cut").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 400), back=st.integers(1, 5), seed=st.integers(0, 99), names=st.sampled_from([("s",), ("s", "t", "u")]))
def test_cuts_inside_a_day_equal_one_window_per_series(spark, many_cuts, n, back, seed, names):
    df = hot_day(spark, n, seed, names)
    short = Layout(time="ts", tie=("event_id",), long=False)
    for run in (
        lambda layout: series.row_index(df, layout).select("series_id", "event_id", "row_idx", "n_rows"),
        lambda layout: series.lags(df, layout, "value", back).select("event_id", "lag_1", f"lag_{back}", "prev_time"),
        lambda layout: series.history(df, layout, "value", back).select("event_id", "window"),
    ):
        assert rows(run(EVENTS), "event_id") == rows(run(short), "event_id")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 300), seed=st.integers(0, 99), names=st.sampled_from([("s",), ("s", "t", "u")]))
def test_asof_over_cuts_of_a_hot_day(spark, many_cuts, n, seed, names):
    """Facts may lie cuts away from their probe, in front of it or nowhere; keys may be null on either side."""
    df = hot_day(spark, n + 200, seed, names).withColumn("series_id", F.when(F.col("event_id") % 17 > 0, F.col("series_id")))
    few = 3 + 40 * (seed % 3)
    facts, probes = df.where(F.col("event_id") % few == 0), df.where(F.col("event_id") % few > 0).withColumnRenamed("event_id", "probe")
    probes = probes.select("series_id", "ts", "probe").unionByName(spark.createDataFrame([("none", dt.datetime(2020, 1, 1), -1)], "series_id string, ts timestamp_ntz, probe long"))
    short = Layout(time="ts", tie=("event_id",), long=False)
    got = [rows(series.asof(probes, facts, layout, ["event_id", "value"]), "probe") for layout in (EVENTS, short)]
    assert got[0] == got[1] and len(got[0]) == probes.count()


def test_asof_of_empty_tables(spark):
    facts = hot_day(spark, 3, 0)
    probes = facts.select("series_id", "ts", F.col("event_id").alias("probe"))
    assert series.asof(probes.limit(0), facts, EVENTS, ["value"]).count() == 0
    assert [r["value"] for r in series.asof(probes, facts.limit(0), EVENTS, ["value"]).collect()] == [None] * 3
    assert series.row_index(facts.limit(0), EVENTS).count() == 0


def test_series_names_come_from_the_data(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "series_id string")
    assert series.series_names(df) == ["a", "b"]
    with pytest.raises(ValueError):
        series.series_names(df, most=1)


def test_numbers_as_order(spark):
    df = spark.range(100).select(F.lit("s").alias("series_id"), "id", F.col("id").cast("double").alias("close"))
    got = series.row_index(df, Layout(time="id")).orderBy("id").collect()
    assert [r["row_idx"] for r in got] == list(range(100)) and got[0]["n_rows"] == 100


def test_outliers_and_downsample(spark):
    df = bars(spark, range(40), values=[1.0 + (i % 4) for i in range(39)] + [100.0])
    flagged = series.outlier_flags(df, "series_id", "close").where("is_outlier").collect()
    assert [r["close"] for r in flagged] == [100.0]
    full = df.select("series_id", "dt", F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", F.lit(1).alias("volume"))
    months = series.downsample(full, BARS, "month").orderBy("bucket").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in months] == [(1.0, 3.0, 31), (4.0, 100.0, 9)]


def ar_table(spark, n, names=("a", "b")):
    parts = []
    for i, name in enumerate(names):
        rng = np.random.default_rng(i)
        parts.append(bars(spark, range(60), name, (100 + rng.normal(size=60).cumsum()).tolist()))
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df, series.split_chronological(series.lag_table(df, BARS, "close", n).drop("row_idx", "n_rows"), BARS)


@pytest.mark.parametrize("n", [1, 3, 5])
def test_autoregression_is_least_squares(spark, n):
    _, table = ar_table(spark, n)
    train = table.where("split = 'train'")
    models = {r["series_id"]: r for r in forecast.fit_autoregression(train, ["series_id"], n).collect()}
    for name, part in train.toPandas().groupby("series_id"):
        x = part[[f"lag_{k}" for k in range(n, 0, -1)]].to_numpy()
        a = np.column_stack([np.ones(len(x)), x])
        want = np.linalg.lstsq(a, part["target"].to_numpy(), rcond=None)[0]
        assert [models[name]["intercept"], *models[name]["coefs"]] == pytest.approx(list(want), rel=1e-6, abs=1e-6)


def test_window_model_agrees_with_autoregression(spark):
    _, table = ar_table(spark, 3, names=("a",))
    train = table.where("split = 'train'")
    own = forecast.predict_autoregression(table, forecast.fit_autoregression(train, ["series_id"], 3), ["series_id"], 3)
    arrays = series.lag_arrays(table, BARS, 3)
    pooled = forecast.predict_window_model(forecast.fit_window_model(arrays.where("split = 'train'"), "X", "y"), arrays, "X")
    a = [r["prediction"] for r in own.orderBy("dt").collect()]
    b = [r["prediction"] for r in pooled.orderBy("dt").collect()]
    assert a == pytest.approx(b, rel=1e-4)
    boosted = forecast.fit_window_model(arrays.where("split = 'train'"), "X", "y", kind="boosted", max_iter=3)
    assert forecast.predict_window_model(boosted, arrays, "X").count() == len(a)
    with pytest.raises(ValueError):
        forecast.fit_window_model(arrays, "X", "y", kind="other")


def test_roll_forward_and_frozen(spark):
    df = bars(spark, range(10), values=[float(v) for v in range(1, 11)])
    models = spark.createDataFrame([("s", 1.0, [0.0, 0.5, 0.25])], "series_id string, intercept double, coefs array<double>")
    starts = forecast.start_windows(df, BARS, "close", 3)
    assert starts.first()["window"] == [6.0, 7.0, 8.0] and starts.first()["horizon"] == 2
    got = [(r["row_idx"], r["prediction"]) for r in forecast.roll_forward(starts, models, ["series_id"]).orderBy("row_idx").collect()]
    first = 1 + 0.5 * 7 + 0.25 * 8
    assert got == [(8, first), (9, 1 + 0.5 * 8 + 0.25 * first)]
    early = forecast.start_windows(df, BARS, "close", 3, start="last_sample")
    assert early.first()["window"] == [5.0, 6.0, 7.0]
    frozen = [(r["row_idx"], r["prediction"]) for r in forecast.frozen_forecast(early, models, ["series_id"]).orderBy("row_idx").collect()]
    assert frozen == [(8, 1 + 3 + 1.75), (9, 1 + 3 + 1.75)]


def windows_of(spark, rows):
    return spark.createDataFrame(rows, "series_id string, window array<double>, first_idx long, horizon long")


def test_any_model_rolls_and_series_of_any_horizon_step_side_by_side(spark, monkeypatch):
    starts = windows_of(spark, [("a", [1.0, 2.0], 5, 4), ("b", [3.0, 4.0], 0, 1), ("c", [0.5, 0.5, 0.5], 9, 3), ("d", [1.0, 1.0], 0, 0)]).coalesce(1)

    def logistic(windows, model):
        return 3.5 * windows[:, -1] * (1 - windows[:, -1]) + 0.1 * windows[:, 0]

    want = []
    for name, window, first, horizon in starts.collect():
        for step in range(horizon):
            value = 3.5 * window[-1] * (1 - window[-1]) + 0.1 * window[0]
            window = [*window[1:], value]
            want.append((name, first + step, pytest.approx(value)))
    assert rows(forecast.roll_forward(starts, None, ["series_id"], logistic), "series_id", "row_idx") == want
    assert forecast.roll_forward(starts.limit(0), None, ["series_id"], logistic).count() == 0


def test_rolled_models_equal_the_fitted_ones_step_by_step(spark):
    """Linear and boosted: the arrays give what the fitted model gives, at every step of a path."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = np.where(x[:, 2] > 0.3, 2.0, -1.0) + x[:, 0] * 0.5
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "X array<double>, y double")
    for kind in ("linear", "boosted"):
        model = forecast.fit_window_model(df, "X", "y", kind=kind, max_iter=5)
        step = forecast.window_predictor(model)
        assert step(x, {}) == pytest.approx([r["prediction"] for r in forecast.predict_window_model(model, df, "X").collect()])
        starts = windows_of(spark, [("a", [0.1, 0.2, 0.9], 3, 4)])
        got = [r["prediction"] for r in forecast.roll_forward(starts, None, ["series_id"], step).orderBy("row_idx").collect()]
        window = [0.1, 0.2, 0.9]
        for value in got:
            one = spark.createDataFrame([(window,)], "X array<double>")
            assert value == pytest.approx(forecast.predict_window_model(model, one, "X").first()["prediction"])
            window = [*window[1:], value]


def test_threshold_model(spark):
    """Two lines; a series that never falls below its level has one for both sides."""
    data = [("a", float(v), 10.0 - v if v >= 5 else 3.0 * v + 1) for v in range(10)] + [("b", 2.0, 4.0), ("b", 2.0, 6.0)]
    table = spark.createDataFrame(data, "series_id string, lag_1 double, target double")
    models = forecast.fit_threshold(table, ["series_id"])
    a, b = models.orderBy("series_id").collect()
    assert (a["level"], b["level"]) == (4.5, 2.0)
    assert [a["high_slope"], a["high_intercept"], a["low_slope"], a["low_intercept"]] == pytest.approx([-1, 10, 3, 1])
    ahead = forecast.predict_threshold(table.where("series_id = 'a'"), models, ["series_id"])
    assert all(r["prediction"] == pytest.approx(r["target"]) for r in ahead.collect())
    starts = windows_of(spark, [("a", [0.0, 4.0], 0, 3)])
    got = [r["prediction"] for r in forecast.roll_forward(starts, models, ["series_id"], forecast.threshold_step).orderBy("row_idx").collect()]
    assert got == pytest.approx([13, -3, -8])


def test_series_without_enough_training_rows_has_no_start(spark):
    assert forecast.start_windows(bars(spark, range(3)), BARS, "close", 3).count() == 0


def test_metrics_and_long_form(spark):
    df = spark.createDataFrame([("s", "test", 1.0, 2.0), ("s", "test", 3.0, 0.0)], "series_id string, split string, target double, prediction double")
    row = forecast.forecast_metrics(df, ["split"]).first()
    assert (row["n"], row["mse"], row["mae"]) == (2, 5.0, 2.0) and row["rmse"] == pytest.approx(5**0.5)
    assert forecast.forecast_long(df, ["series_id", "split"], ["target", "prediction"]).count() == 4


def test_no_forecast_row_sees_its_own_day_or_later(spark):
    """Changing a value leaves every prediction up to its own date as it was."""
    df, _ = ar_table(spark, 3, names=("a",))
    changed = df.withColumn("close", F.when(F.col("dt") == DAY0 + dt.timedelta(55), 1e6).otherwise(F.col("close")))

    def predictions(frame):
        table = series.split_chronological(series.lag_table(frame, BARS, "close", 3).drop("row_idx", "n_rows"), BARS)
        models = forecast.fit_autoregression(table.where("split = 'train'"), ["series_id"], 3)
        return rows(forecast.predict_autoregression(table, models, ["series_id"], 3).select("series_id", "dt", "prediction"))

    before, after = predictions(df), predictions(changed)
    keep = [i for i, r in enumerate(before) if r[1] <= DAY0 + dt.timedelta(55)]
    assert [before[i] for i in keep] == [after[i] for i in keep]
    assert before != after
