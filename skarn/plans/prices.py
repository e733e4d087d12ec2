"""Price-series queries.

Bars are laid out by series (at most one row per series and day, or hour); single events, of
which one series may hold any share, are laid out in range cuts. A query that needs its bars
more than once stores them: a few rows per day, against a second pass over all orders.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from skarn.functions import numeric
from skarn.operators import forecast, scoring, series
from skarn.operators.joins import align
from skarn.operators.series import BARS, Layout
from skarn.sources import views
from skarn.sources.files import stored

HOURS = Layout(time="dt", tie=("hr",), long=False)
TICKS = Layout(time="ts", tie=("event_id",), block=5_000)
KEY = ["series_id"]
FIRST, LAST = dt.date(1996, 3, 25), dt.date(1997, 3, 23)

# Coefficients of the fixed-model queries, oldest lag first.
FIXED_INTERCEPT, FIXED_COEFS = 9000.0, (0.15, 0.2, 0.6)


def _closes(spark, sf_dir):
    return views.prices(spark, sf_dir).select("series_id", "dt", "close")


def _lag_split(spark, sf_dir, n):
    """Lag table with its own chronological split: positions count the rows of the table."""
    table = series.lag_table(_closes(spark, sf_dir), BARS, "close", n).drop("row_idx", "n_rows")
    return series.split_chronological(table, BARS)


def row_index(spark, sf_dir):
    return series.row_index(_closes(spark, sf_dir), BARS)


def row_index_ticks(spark, sf_dir):
    return series.row_index(views.ticks(spark, sf_dir), TICKS).select("series_id", "event_id", "row_idx", "n_rows")


def lag_features(spark, sf_dir):
    table = series.lag_table(_closes(spark, sf_dir), BARS, "close", 3, FIRST, LAST)
    return table.drop("row_idx", "n_rows")


def lag_features_capped_gap(spark, sf_dir):
    table = series.lag_table(views.prices_all(spark, sf_dir).select("series_id", "dt", "close"), BARS, "close", 3, max_gap_days=3)
    return table.drop("row_idx", "n_rows")


def lag_features_ticks(spark, sf_dir):
    out = series.lags(views.ticks(spark, sf_dir), TICKS, "value", 3)
    return out.where(F.col("row_idx") >= 3).select("series_id", "event_id", "lag_3", "lag_2", "lag_1", "value")


def lag_to_arrays(spark, sf_dir):
    table = series.lag_table(_closes(spark, sf_dir), BARS, "close", 3, FIRST, LAST)
    arrays = series.lag_arrays(table, BARS, 3)
    exploded = arrays.select("series_id", "dt", F.posexplode("X").alias("pos", "x"), "y")
    return exploded.withColumns({"x": F.round(F.col("x").cast("double"), 1), "y": F.round(F.col("y").cast("double"), 1)})


def history_windows(spark, sf_dir):
    bars = views.hourly(spark, sf_dir).select("series_id", "dt", "hr", "close")
    windows = series.history(bars, HOURS, "close", 60)
    return windows.select("series_id", "row_idx", F.posexplode("window").alias("pos", "value"))


def history_windows_ticks(spark, sf_dir):
    """Windows of single events, as the mean of each window and its first and last value."""
    windows = series.history(views.ticks(spark, sf_dir), TICKS, "value", 60)
    mean = F.aggregate("window", F.lit(0.0), lambda a, v: a + v) / 60
    return windows.select(
        "series_id",
        "event_id",
        F.col("window")[0].alias("oldest"),
        F.col("window")[59].alias("newest"),
        F.round(mean, 5).alias("mean"),
    )


def next_observation(spark, sf_dir):
    out = series.next_observation(views.prices_all(spark, sf_dir).select("series_id", "dt"), BARS)
    return out.select("series_id", "dt", F.col("next_time").alias("next_dt"), "gap_days", "within")


def split_chrono(spark, sf_dir):
    return _lag_split(spark, sf_dir, 3).select("series_id", "dt", "row_idx", "split")


def split_holdout(spark, sf_dir):
    bars = views.hourly(spark, sf_dir).select("series_id", "dt", "hr")
    return series.split_holdout(bars, HOURS).select("series_id", "dt", "hr", "row_idx", "split")


def last_k_per_series(spark, sf_dir):
    return series.last_k(_closes(spark, sf_dir), BARS, 4)


def last_k_ticks(spark, sf_dir):
    return series.last_k(views.ticks(spark, sf_dir).select("series_id", "ts", "event_id", "value"), TICKS, 4).select(
        "series_id", "event_id", "value", "rank"
    )


def asof_price(spark, sf_dir):
    """Close at or before the middle and the last but one day of every month, per series."""
    bars = stored(_closes(spark, sf_dir))
    months = bars.select("series_id", F.trunc("dt", "month").alias("m")).distinct()
    probes = months.select("series_id", F.explode(F.array(F.date_add("m", 14), F.date_add(F.last_day("m"), -1))).alias("dt"))
    out = series.asof(probes, bars, BARS, ["close"])
    return out.select("series_id", "dt", F.col("fact_time").alias("fact_dt"), "close")


def asof_ticks(spark, sf_dir):
    """For each error event the last value seen in each other series before it."""
    ticks = views.ticks(spark, sf_dir)
    facts = ticks.where(F.col("series_id") != "error")
    others = F.array(*[F.lit(s) for s in series.series_names(facts)]).cast("array<string>")
    probes = ticks.where(F.col("series_id") == "error").select(F.explode(others).alias("series_id"), "ts", F.col("event_id").alias("probe_id"))
    out = series.asof(probes, facts, TICKS, ["event_id", "value"])
    return out.select("series_id", "probe_id", "event_id", "value")


def zscore_series(spark, sf_dir):
    """Scaled by the training rows only."""
    split = series.split_chronological(_closes(spark, sf_dir), BARS)
    scaled = series.with_scaler(split, BARS, "close", F.col("split") == "train")
    z = numeric.zscore(F.col("close"), F.col("mean"), F.col("std"))
    return scaled.select("series_id", "dt", "split", F.round(z, 6).alias("z"))


def zscore_roundtrip(spark, sf_dir):
    """Scaled by all rows, and back."""
    scaled = series.with_scaler(_closes(spark, sf_dir), BARS, "close").withColumn(
        "z", numeric.zscore(F.col("close"), F.col("mean"), F.col("std"))
    )
    back = numeric.inverse_zscore(F.col("z"), F.col("mean"), F.col("std"))
    return scaled.select("series_id", "dt", F.round("z", 6).alias("z"), F.round(back, 4).alias("close"))


def minmax_series(spark, sf_dir):
    scaled = series.with_scaler(_closes(spark, sf_dir), BARS, "close")
    value = numeric.minmax(F.col("close"), F.col("low"), F.col("high"))
    return scaled.select("series_id", "dt", F.round(value, 6).alias("scaled"))


def zscore_ticks(spark, sf_dir):
    scaled = series.with_scaler(views.ticks(spark, sf_dir), TICKS, "value")
    z = numeric.zscore(F.col("value"), F.col("mean"), F.col("std"))
    return scaled.select("series_id", "event_id", F.round(z, 6).alias("z"))


def persistence_forecast(spark, sf_dir):
    return forecast.persistence(_lag_split(spark, sf_dir, 1)).select("series_id", "dt", "split", "target", "prediction")


def _autoregression(table, n):
    models = forecast.fit_autoregression(table.where(F.col("split") == "train"), KEY, n)
    return forecast.predict_autoregression(table, models, KEY, n)


def ar1_forecast(spark, sf_dir):
    out = _autoregression(stored(_lag_split(spark, sf_dir, 1)), 1)
    return out.select("series_id", "dt", "split", "target", F.round("prediction", 3).alias("prediction"))


def ar3_forecast(spark, sf_dir):
    out = _autoregression(stored(_lag_split(spark, sf_dir, 3)), 3)
    return out.select("series_id", "dt", "split", "target", F.round("prediction", 3).alias("prediction"))


def forecast_metrics(spark, sf_dir):
    out = forecast.forecast_metrics(_autoregression(stored(_lag_split(spark, sf_dir, 1)), 1), ["series_id", "split"])
    return out.select(
        "series_id", "split", "n", F.round("mse", 0).alias("mse"), F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse")
    )


def forecast_vs_actual(spark, sf_dir):
    """Test rows with the forecasts put beside them by position."""
    table = stored(_lag_split(spark, sf_dir, 3))
    test = table.where(F.col("split") == "test").select("series_id", "row_idx", "dt", "target")
    predictions = _autoregression(table, 3).select("series_id", "row_idx", "prediction")
    both = align(test, predictions)
    return both.select("series_id", "row_idx", "dt", "target", F.round("prediction", 3).alias("prediction"))


def forecast_by_split(spark, sf_dir):
    """One pooled model over the lag vectors of all series, applied to every split at once."""
    table = series.lag_arrays(stored(_lag_split(spark, sf_dir, 3)), BARS, 3)
    model = forecast.fit_window_model(table.where(F.col("split") == "train"), "X", "y")
    out = forecast.predict_window_model(model, table, "X")
    return out.select("series_id", "dt", "split", "y", F.round("prediction", 2).alias("prediction"))


def window60_forecast(spark, sf_dir):
    """60-step windows of the scaled series, holdout split, prediction scaled back."""
    bars = series.split_holdout(views.hourly(spark, sf_dir).select("series_id", "dt", "hr", "close"), HOURS)
    scaled = series.with_scaler(bars, HOURS, "close", F.col("split") == "train").withColumn(
        "z", numeric.zscore(F.col("close"), F.col("mean"), F.col("std"))
    )
    windows = series.history(stored(scaled), HOURS, "z", 60)
    model = forecast.fit_window_model(windows.where(F.col("split") == "train"), "window", "z", reg_param=0.1)
    out = forecast.predict_window_model(model, windows.where(F.col("split") == "test"), "window", "z_hat")
    value = numeric.inverse_zscore(F.col("z_hat"), F.col("mean"), F.col("std"))
    return out.select("series_id", "dt", "hr", "close", value.alias("prediction"))


def forecast_horizon(spark, sf_dir):
    """Validation and test dates in one pass; the split column tells them apart."""
    table = _lag_split(spark, sf_dir, 3)
    return table.where(F.col("split").isin("val", "test")).select("series_id", "dt", "split")


def _fixed_models(bars):
    names = bars.select("series_id").distinct()
    return names.select("series_id", F.lit(FIXED_INTERCEPT).alias("intercept"), F.array(*[F.lit(c) for c in FIXED_COEFS]).alias("coefs"))


def recursive_forecast(spark, sf_dir):
    bars = stored(series.row_index(_closes(spark, sf_dir), BARS))
    starts = forecast.start_windows(bars, BARS, "close", 3)
    out = forecast.roll_forward(starts, _fixed_models(bars), KEY)
    dated = align(out, bars.select("series_id", "row_idx", "dt"))
    return dated.select("series_id", "row_idx", "dt", F.round("prediction", 4).alias("prediction"))


def _rolled(table, models, predict=forecast.linear_step):
    """From the end of the training rows of a lag table through the rest of it, by a model fitted to them."""
    values = table.select("series_id", "dt", "row_idx", "n_rows", F.col("target").alias("value"))
    starts = forecast.start_windows(values, BARS, "value", 3)
    return forecast.roll_forward(starts, models, KEY, predict)


def recursive_forecast_ar3(spark, sf_dir):
    """The fitted lag model fed with its own forecasts."""
    table = stored(_lag_split(spark, sf_dir, 3))
    models = forecast.fit_autoregression(table.where(F.col("split") == "train"), KEY, 3).drop("n_fit")
    dated = align(_rolled(table, models), table.select("series_id", "row_idx", "dt"))
    return dated.select("series_id", "row_idx", "dt", F.round("prediction", 3).alias("prediction"))


def threshold_forecast(spark, sf_dir):
    """A fitted model that is not linear: one step ahead, and fed with its own forecasts."""
    table = stored(_lag_split(spark, sf_dir, 3))
    models = stored(forecast.fit_threshold(table.where(F.col("split") == "train"), KEY))
    ahead = forecast.predict_threshold(table, models, KEY).select("series_id", "row_idx", "dt", "split", "prediction")
    both = align(ahead, _rolled(table, models, forecast.threshold_step).withColumnRenamed("prediction", "recursive"))
    return both.select("series_id", "dt", "split", F.round("prediction", 3).alias("prediction"), F.round("recursive", 3).alias("recursive"))


def boosted_forecast(spark, sf_dir):
    """A boosted model over the lag vectors of all series, fed with its own forecasts."""
    table = stored(_lag_split(spark, sf_dir, 3))
    arrays = series.lag_arrays(table.where(F.col("split") == "train"), BARS, 3)
    model = forecast.fit_window_model(arrays, "X", "y", kind="boosted")
    dated = align(_rolled(table, None, forecast.window_predictor(model)), table.select("series_id", "row_idx", "dt"))
    return dated.select("series_id", "row_idx", "dt", "prediction")


SCALE, WEIGHT, MEMORY = 300_000.0, 0.9, 0.6  # of the sequence model that stands for one trained elsewhere


def _load_sequence_model():
    def predict(windows):
        state = np.zeros(len(windows))
        for k in range(windows.shape[1]):
            state = np.tanh(WEIGHT * windows[:, k] / SCALE + MEMORY * state)
        return (SCALE * state)[:, None]

    return predict


def sequence_forecast(spark, sf_dir):
    """Batch inference of a recurrent model over the history windows."""
    table = series.lag_table(_closes(spark, sf_dir), BARS, "close", 3)
    windows = table.select("series_id", "dt", F.array("lag_3", "lag_2", "lag_1").alias("window"))
    out = scoring.model_forecast(windows, _load_sequence_model, "window", 3)
    return out.select("series_id", "dt", F.round("prediction", 3).alias("prediction"))


def frozen_forecast(spark, sf_dir):
    bars = stored(series.row_index(_closes(spark, sf_dir), BARS))
    starts = forecast.start_windows(bars, BARS, "close", 3, start="last_sample")
    out = forecast.frozen_forecast(starts, _fixed_models(bars), KEY)
    dated = align(out, bars.select("series_id", "row_idx", "dt"))
    return dated.select("series_id", "row_idx", "dt", F.round("prediction", 4).alias("prediction"))


def forecast_long(spark, sf_dir):
    """Observed, one-step and baseline values over all splits as one long table."""
    out = forecast.persistence(_autoregression(stored(_lag_split(spark, sf_dir, 1)), 1).withColumnRenamed("prediction", "predicted"))
    out = out.withColumnsRenamed({"target": "observed", "prediction": "baseline"})
    out = out.withColumn("predicted", F.round("predicted", 3))
    return forecast.forecast_long(out, ["series_id", "dt", "split"], ["observed", "predicted", "baseline"])


def forecast_overlay(spark, sf_dir):
    """All four kinds over all splits: observed, one-step, baseline, and the model fed with its own forecasts."""
    table = stored(_lag_split(spark, sf_dir, 3))
    models = stored(forecast.fit_autoregression(table.where(F.col("split") == "train"), KEY, 3).drop("n_fit"))
    out = forecast.persistence(forecast.predict_autoregression(table, models, KEY, 3).withColumnRenamed("prediction", "predicted"))
    out = align(out, _rolled(table, models).withColumnRenamed("prediction", "recursive"), ("series_id", "row_idx"))
    out = out.withColumn("baseline", F.col("lag_1")).withColumnsRenamed({"target": "observed"})
    out = out.withColumns({c: F.round(c, 3) for c in ("predicted", "recursive")})
    return forecast.forecast_long(out, ["series_id", "dt", "split"], ["observed", "predicted", "baseline", "recursive"])


def volume_outliers(spark, sf_dir):
    bars = stored(views.prices(spark, sf_dir).select("series_id", "dt", "volume"))
    return series.outlier_flags(bars, "series_id", "volume").withColumns(
        {c: F.round(c, 4) for c in ("q1", "q3")}
    )


def value_outliers_ticks(spark, sf_dir):
    ticks = views.ticks(spark, sf_dir).select("series_id", "event_id", "value")
    flagged = series.outlier_flags(ticks, "series_id", "value").where("is_outlier")
    return flagged.select("series_id", "event_id", "value", F.round("q1", 5).alias("q1"), F.round("q3", 5).alias("q3"))


def price_downsample(spark, sf_dir):
    out = series.downsample(views.prices(spark, sf_dir), BARS, "month")
    return out.withColumn("avg_close", F.round("avg_close", 6))


QUERIES = {
    f.__name__: f
    for f in (
        row_index,
        row_index_ticks,
        lag_features,
        lag_features_capped_gap,
        lag_features_ticks,
        lag_to_arrays,
        history_windows,
        history_windows_ticks,
        next_observation,
        split_chrono,
        split_holdout,
        last_k_per_series,
        last_k_ticks,
        asof_price,
        asof_ticks,
        zscore_series,
        zscore_roundtrip,
        zscore_ticks,
        minmax_series,
        persistence_forecast,
        ar1_forecast,
        ar3_forecast,
        forecast_metrics,
        forecast_vs_actual,
        forecast_by_split,
        window60_forecast,
        forecast_horizon,
        recursive_forecast,
        recursive_forecast_ar3,
        threshold_forecast,
        boosted_forecast,
        sequence_forecast,
        frozen_forecast,
        forecast_long,
        forecast_overlay,
        volume_outliers,
        value_outliers_ticks,
        price_downsample,
    )
}
