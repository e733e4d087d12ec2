"""Regression forecasts, roll-forward, baseline and error measures for many series."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from skarn.operators.joins import join_groups
from skarn.operators.series import Layout, row_index


@F.pandas_udf(ArrayType(DoubleType()))
def _solve(gram: pd.Series, cross: pd.Series) -> pd.Series:
    """Least-squares coefficients from a model's covariances: a handful of numbers per series."""
    solved = []
    for g, c in zip(gram, cross):
        n = len(c)
        solved.append(np.linalg.lstsq(np.asarray(g, dtype=float).reshape(n, n), np.asarray(c, dtype=float), rcond=None)[0])
    return pd.Series(solved)


def fit_autoregression(train: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """Least squares of target on lag_n .. lag_1, one model per series: (key, n_fit, intercept, coefs).

    `coefs` runs from the oldest lag to the newest. All series are fitted by one aggregate of
    means and covariances, which combines on the map side, so a long series is no burden.
    """
    names = [f"lag_{k}" for k in range(n, 0, -1)]
    if n == 1:
        return train.groupBy(*key).agg(
            F.count("target").alias("n_fit"),
            F.regr_intercept("target", "lag_1").alias("intercept"),
            F.array(F.regr_slope("target", "lag_1")).alias("coefs"),
        )
    moments = [F.count("target").alias("n_fit"), F.avg("target").alias("mean_y")]
    moments += [F.avg(x).alias(f"mean_{i}") for i, x in enumerate(names)]
    moments += [F.covar_pop(x, "target").alias(f"cross_{i}") for i, x in enumerate(names)]
    moments += [F.covar_pop(names[i], names[j]).alias(f"gram_{i}_{j}") for i in range(n) for j in range(i, n)]
    stats = train.groupBy(*key).agg(*moments)
    gram = F.array(*[F.col(f"gram_{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(n)])
    cross = F.array(*[F.col(f"cross_{i}") for i in range(n)])
    solved = stats.withColumn("coefs", _solve(gram, cross))
    intercept = F.col("mean_y")
    for i in range(n):
        intercept = intercept - F.col("coefs")[i] * F.col(f"mean_{i}")
    return solved.select(*key, "n_fit", intercept.alias("intercept"), "coefs")


def linear_value(window: Column, intercept: Column, coefs: Column) -> Column:
    products = F.zip_with(window, coefs, lambda x, c: x * c)
    return intercept + F.aggregate(products, F.lit(0.0), lambda a, v: a + v)


def predict_autoregression(table: DataFrame, models: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """Add `prediction` to a lag table. The models are one small row per series."""
    joined = table.join(models.select(*key, "intercept", "coefs"), list(key), "left")
    prediction = F.col("intercept")
    for i, k in enumerate(range(n, 0, -1)):
        prediction = prediction + F.col("coefs")[i] * F.col(f"lag_{k}")
    return joined.withColumn("prediction", prediction).drop("intercept", "coefs")


def persistence(table: DataFrame) -> DataFrame:
    """The last value as the forecast: the yardstick for any model."""
    return table.withColumn("prediction", F.col("lag_1"))


def fit_window_model(
    df: DataFrame, window_col: str, target: str, reg_param: float = 0.0, kind: str = "linear", max_iter: int = 20
):
    """One pooled regressor on window arrays over all series. kind: 'linear' or 'boosted'."""
    points = df.select(array_to_vector(F.col(window_col).cast("array<double>")).alias("features"), F.col(target).cast("double").alias("label"))
    if kind == "linear":  # one pass: nothing to keep
        return LinearRegression(solver="normal", regParam=reg_param).fit(points)
    if kind != "boosted":
        raise ValueError(f"unknown kind {kind!r}")
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return GBTRegressor(maxIter=max_iter, maxDepth=4, seed=0).fit(points)
    finally:
        points.unpersist()


def predict_window_model(model, df: DataFrame, window_col: str, name: str = "prediction") -> DataFrame:
    """Add the prediction for every row, whatever its split, in one pass."""
    with_vectors = df.withColumn("features", array_to_vector(F.col(window_col).cast("array<double>")))
    return model.transform(with_vectors).withColumnRenamed("prediction", name).drop("features")


def start_windows(
    df: DataFrame, layout: Layout, value: str, n: int, train: float = 0.8, start: str = "last_observed"
) -> DataFrame:
    """(key, window, first_idx, horizon): where the forecast of each series sets off.

    start='last_observed': the last n training values. start='last_sample': the inputs of the
    last training row, which end one value earlier.
    """
    indexed = row_index(df, layout)
    cut = F.floor(F.col("n_rows") * F.lit(train))
    back = 0 if start == "last_observed" else 1
    picks = [
        F.max(F.when(F.col("row_idx") == cut - k - back, F.col(value))).alias(f"w{k}") for k in range(n, 0, -1)
    ]
    near = indexed.where((F.col("row_idx") < cut) & (F.col("row_idx") >= cut - n - back))
    windows = near.groupBy(*layout.key).agg(*picks, F.max("n_rows").alias("n_rows"))
    whole = F.array(*[F.col(f"w{k}") for k in range(n, 0, -1)])
    return windows.select(
        *layout.key, whole.alias("window"), cut.alias("first_idx"), (F.col("n_rows") - cut).alias("horizon")
    ).where((F.col("horizon") > 0) & ~F.exists("window", F.isnull))


Predict = Callable[[np.ndarray, Mapping[str, np.ndarray]], np.ndarray]
ROLLED = 100_000  # forecasts passed on at a time


def linear_step(windows: np.ndarray, model: Mapping[str, np.ndarray]) -> np.ndarray:
    return model["intercept"] + (windows * model["coefs"]).sum(axis=1)


def threshold_step(windows: np.ndarray, model: Mapping[str, np.ndarray]) -> np.ndarray:
    """One line from the level of the series upwards, another below it."""
    last = windows[:, -1]
    high = model["high_intercept"] + model["high_slope"] * last
    return np.where(last >= model["level"], high, model["low_intercept"] + model["low_slope"] * last)


def roll_forward(starts: DataFrame, models: DataFrame | None, key: Sequence[str], predict: Predict = linear_step) -> DataFrame:
    """(key, row_idx, prediction): each forecast enters the window of the next one.

    `predict` takes the windows of many series (a row each, oldest value first) and the columns of
    `models` for them, and gives their next values; `models` is None where one model serves all
    series (see `window_predictor`). Series step side by side: a task holds one window per series
    and the forecasts it has not passed on yet, so the work grows with the horizon, not its square.
    Series without a model have no rows.
    """
    key = list(key)
    joined = starts if models is None else starts.join(models, key)
    schema = joined.select(*key, F.lit(0).cast("long").alias("row_idx"), F.lit(0.0).alias("prediction")).schema
    return joined.mapInArrow(_rolled(key, predict), schema)


def _matrix(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return np.array(column.to_pylist(), dtype=float).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _rolled(key: list[str], predict: Predict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("window")).to_numpy()
            for size in np.unique(sizes):  # windows of one length make one matrix
                yield from rolled(batch.take(pa.array(np.flatnonzero(sizes == size))))

    def rolled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ahead = batch.column("horizon").to_numpy()
        batch = batch.take(pa.array(np.argsort(-ahead, kind="stable")))  # those that go on longest come first
        ahead, first = batch.column("horizon").to_numpy(), batch.column("first_idx").to_numpy()
        windows = _matrix(batch.column("window"))
        own = {c: _matrix(batch.column(c)) for c in batch.schema.names if c not in (*key, "window", "horizon", "first_idx")}
        who, place, value, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            rows = pa.array(np.concatenate(who))
            columns = [*[batch.column(c).take(rows) for c in key], pa.array(np.concatenate(place)), pa.array(np.concatenate(value))]
            return pa.RecordBatch.from_arrays(columns, [*key, "row_idx", "prediction"])

        for step in range(int(ahead.max(initial=0))):
            n = int(np.searchsorted(-ahead, -step, side="left"))  # horizons longer than this step
            if len(windows) > n:
                windows, own = windows[:n], {c: v[:n] for c, v in own.items()}
            following = np.asarray(predict(windows, own), dtype=float)
            windows = np.concatenate([windows[:, 1:], following[:, None]], axis=1)
            who.append(np.arange(n))
            place.append(first[:n] + step)
            value.append(following)
            held += n
            if held >= ROLLED:
                yield out()
                who, place, value, held = [], [], [], 0
        if held:
            yield out()

    return run


def fit_threshold(train: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, level, high_intercept, high_slope, low_intercept, low_slope): least squares on lag_1 above and below its mean.

    A side of fewer than two different values takes the other side's line.
    """
    levels = train.groupBy(*key).agg(F.avg("lag_1").alias("level"))
    sided = join_groups(train.select(*key, "lag_1", "target"), levels, key)
    high = F.col("lag_1") >= F.col("level")
    lines = sided.groupBy(*key, "level").agg(
        *[
            line(F.when(where, F.col("target")), F.when(where, F.col("lag_1"))).alias(f"{side}_{name}")
            for side, where in (("high", high), ("low", ~high))
            for name, line in (("intercept", F.regr_intercept), ("slope", F.regr_slope))
        ]
    )
    sides = {"high": "low", "low": "high"}
    whole = {
        f"{side}_{name}": F.when(F.col(f"{side}_slope").isNull(), F.col(f"{other}_{name}")).otherwise(F.col(f"{side}_{name}"))
        for side, other in sides.items()
        for name in ("intercept", "slope")
    }
    return lines.select(*key, "level", *[c.alias(name) for name, c in whole.items()])


def predict_threshold(table: DataFrame, models: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add `prediction` to a lag table."""
    joined = table.join(models, list(key), "left")
    high = F.col("high_intercept") + F.col("high_slope") * F.col("lag_1")
    low = F.col("low_intercept") + F.col("low_slope") * F.col("lag_1")
    prediction = F.when(F.col("lag_1") >= F.col("level"), high).otherwise(low)
    return joined.withColumn("prediction", prediction).drop(*[c for c in models.columns if c not in key])


def window_predictor(model) -> Predict:
    """A fitted model of `fit_window_model` as arrays, for `roll_forward`: it needs neither the JVM nor a job per step."""
    if not hasattr(model, "treeWeights"):
        coefs, intercept = np.array(model.coefficients), float(model.intercept)
        return lambda windows, _: intercept + windows @ coefs
    trees = [_flat_tree(tree._java_obj.rootNode()) for tree in model.trees]
    weights = list(model.treeWeights)

    def predict(windows: np.ndarray, _: Mapping[str, np.ndarray]) -> np.ndarray:
        total = np.zeros(len(windows))
        rows = np.arange(len(windows))
        for weight, (feature, threshold, left, right, value) in zip(weights, trees, strict=True):
            node = np.zeros(len(windows), int)
            while (left[node] >= 0).any():
                below = windows[rows, feature[node]] <= threshold[node]
                node = np.where(left[node] < 0, node, np.where(below, left[node], right[node]))
            total += weight * value[node]
        return total

    return predict


def _flat_tree(root) -> tuple[np.ndarray, ...]:
    """(feature, threshold, left, right, value) of every node; no left child at a leaf."""
    nodes, todo = [], [root]
    while len(nodes) < len(todo):
        node = todo[len(nodes)]
        if node.getClass().getSimpleName() == "LeafNode":
            nodes.append((0, 0.0, -1, -1, node.prediction()))
        else:
            split = node.split()
            nodes.append((split.featureIndex(), split.threshold(), len(todo), len(todo) + 1, node.prediction()))
            todo += [node.leftChild(), node.rightChild()]
    kinds = (int, float, int, int, float)
    return tuple(np.array(column, dtype=kind) for column, kind in zip(zip(*nodes, strict=True), kinds, strict=True))


def frozen_forecast(starts: DataFrame, models: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, row_idx, prediction): the same window for every date, hence a constant forecast."""
    joined = starts.join(models.select(*key, "intercept", "coefs"), list(key))
    value = linear_value(F.col("window"), F.col("intercept"), F.col("coefs"))
    ahead = F.sequence(F.col("first_idx"), F.col("first_idx") + F.col("horizon") - 1)
    return joined.select(*key, F.explode(ahead).alias("row_idx"), value.alias("prediction"))


def forecast_metrics(df: DataFrame, by: Sequence[str], actual: str = "target", predicted: str = "prediction") -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.count(error).alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def forecast_long(df: DataFrame, ids: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Overlay table (ids, kind, value); a kind that has no value at a date has no row."""
    same = [F.col(k).cast("double").alias(k) for k in kinds]
    return df.select(*ids, *same).unpivot(list(ids), list(kinds), "kind", "value").where(F.col("value").isNotNull())
