"""Batch scoring with caller-supplied models, quarantine, and comparison of two scorers."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from skarn.functions.numeric import softmax
from skarn.operators.columns import prefix_columns
from skarn.operators.joins import natural_left_join
from skarn.operators.quantiles import exact_quantiles
from skarn.sources.files import stored

CLASSES = ("neg", "neu", "pos")


def rejection(text: Column, max_chars: int | None = None) -> Column:
    """Why a text cannot be scored, or NULL. Every scorer here and the quarantine follow it."""
    reason = F.when(text.isNull(), "null text").when(~text.rlike(r"\S"), "blank text")
    if max_chars is not None:
        reason = reason.when(F.length(text) > max_chars, "text too long")
    return reason


def scorable(df: DataFrame, text_col: str = "Text", max_chars: int | None = None) -> DataFrame:
    return df.where(rejection(F.col(text_col), max_chars).isNull())


def quarantine(df: DataFrame, id_col: str = "Id", text_col: str = "Text", max_chars: int | None = None) -> DataFrame:
    """(id, reason) of the rows that `scorable` leaves out."""
    return df.select(id_col, rejection(F.col(text_col), max_chars).alias("reason")).where(F.col("reason").isNotNull())


def isolating(make_predict: Callable, n_out: int, caught: type[Exception] = RuntimeError) -> Callable:
    """Wrap a model factory so that a row the model fails on gives NaN and spares its batch."""

    def make():
        predict = make_predict()

        def guarded(batch: np.ndarray) -> np.ndarray:
            try:
                return np.asarray(predict(batch), dtype=np.float64)
            except caught:
                out = np.full((len(batch), n_out), np.nan)
                for i in range(len(batch)):
                    try:
                        out[i] = predict(batch[i : i + 1])[0]
                    except caught:
                        continue
                return out

        return guarded

    return make


def model_scores(
    df: DataFrame,
    make_predict: Callable,
    id_col: str = "Id",
    text_col: str = "Text",
    batch_size: int = 64,
) -> DataFrame:
    """(id, neg, neu, pos, failed) from a model that maps a batch of texts to rows of three logits.

    `make_predict` runs once per Python worker and loads the model there. Texts go over in
    Arrow batches; softmax stays in the JVM. A row the model raises RuntimeError on has NULL
    scores and `failed`, and so has a text that `rejection` refuses, whatever the model says to
    it. Rows that repeat an id are scored each for itself.
    """
    infer = predict_batch_udf(
        isolating(make_predict, 3), return_type=ArrayType(DoubleType()), batch_size=batch_size
    )
    text = F.col(text_col)
    logits = df.select(id_col, rejection(text).alias("reason"), infer(F.coalesce(text, F.lit(""))).alias("z"))
    failed = F.col("reason").isNotNull() | ~F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v))
    logits = logits.select(id_col, failed.alias("failed"), "z")
    probs = logits.select(id_col, "failed", F.when(~F.col("failed"), softmax(F.col("z"))).alias("p"))
    return probs.select(id_col, *[F.col("p")[i].alias(c) for i, c in enumerate(CLASSES)], "failed")


def scoring_failures(scores: DataFrame, id_col: str = "Id") -> DataFrame:
    """(id, reason) of the rows without scores that the quarantine does not name, in its form."""
    return scores.where("failed").select(id_col, F.lit("scorer failed").alias("reason"))


def outcomes(df: DataFrame, scores: DataFrame, id_col: str = "Id", text_col: str = "Text") -> DataFrame:
    """(id, outcome) of every row: `scored`, why the text was refused, or `scorer failed`."""
    refused = df.select(id_col, rejection(F.col(text_col)).alias("reason"))
    joined = refused.join(scores.select(id_col, "failed"), id_col, "left")
    failed = F.when(F.coalesce("failed", F.lit(True)), "scorer failed").otherwise("scored")
    return joined.select(id_col, F.coalesce("reason", failed).alias("outcome"))


def model_forecast(df: DataFrame, make_predict: Callable, window_col: str, length: int, batch_size: int = 512) -> DataFrame:
    """Add `prediction` from an externally trained sequence model over windows of one length."""
    infer = predict_batch_udf(
        isolating(make_predict, 1), return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[length]]
    )
    return df.withColumn("prediction", infer(F.col(window_col).cast("array<double>"))[0])


def rating_class(score: Column) -> Column:
    """Class of a star rating: 1-2 neg, 3 neu, 4-5 pos."""
    return F.when(score <= 2, "neg").when(score == 3, "neu").when(score >= 4, "pos")


def fit_text_classifier(
    df: DataFrame, score_col: str = "Score", text_col: str = "Text", n_features: int = 1 << 14, max_iter: int = 100
) -> PipelineModel:
    """Three-class classifier learnt from the rated rows."""
    label = F.when(F.col(score_col) <= 2, 0.0).when(F.col(score_col) == 3, 1.0).when(F.col(score_col) >= 4, 2.0)
    rated = df.where(F.col(score_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), label.alias("label")
    )
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+")
    hashed = HashingTF(inputCol="words", outputCol="tf", numFeatures=n_features)
    # the fits pass over the hashed counts, not over the texts
    counts = hashed.transform(words.transform(rated)).select("tf", "label").persist(StorageLevel.MEMORY_AND_DISK)
    fitted = [
        IDF(inputCol="tf", outputCol="features", minDocFreq=2),
        LogisticRegression(family="multinomial", maxIter=max_iter, regParam=0.01),
    ]
    try:
        return PipelineModel([words, hashed, *Pipeline(stages=fitted).fit(counts).stages])
    finally:
        counts.unpersist()


def classifier_scores(model: PipelineModel, df: DataFrame, id_col: str = "Id", text_col: str = "Text") -> DataFrame:
    """(id, neg, neu, pos) of every row, rated or not; NULL scores where `rejection` refuses the text."""
    text = F.col(text_col)
    shown = df.select(id_col, rejection(text).alias("reason"), F.coalesce(text, F.lit("")).alias("text"))
    p = model.transform(shown).select(id_col, F.when(F.col("reason").isNull(), vector_to_array("probability")).alias("p"))
    return p.select(id_col, *[F.col("p")[i].alias(c) for i, c in enumerate(CLASSES)])


FEATURES = 1 << 14  # cells of a word's hash in the count classifier


def _class_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _cell(word: Column) -> Column:
    """The cell of a word: the first 16 bits of its MD5, which other engines have as well."""
    return (F.conv(F.substring(F.md5(word), 1, 4), 16, 10).cast("int") % FEATURES).cast("int")


def fit_count_classifier(df: DataFrame, score_col: str = "Score", text_col: str = "Text", smooth: float = 1.0) -> list[tuple[float, ...]]:
    """Naive Bayes of three classes, from counts that one pass adds up: log priors, then log shares of each cell.

    A row per cell of hashed words, and one number per class in it. The counts of a class are what
    its estimate needs (its score equations are solved in closed form), so there is nothing to
    iterate. At most 3 * `FEATURES` counts reach the driver, whatever the number of texts. Rows
    without rating or text are left out; a class without rows keeps the smoothing.
    """
    label = F.when(F.col(score_col) <= 2, 0).when(F.col(score_col) == 3, 1).when(F.col(score_col) >= 4, 2)
    rated = df.where(F.col(score_col).isNotNull() & F.col(text_col).isNotNull()).select(label.alias("label"), F.col(text_col).alias("text"))
    # one cell beyond the others counts the texts
    cells = F.concat(F.array(F.lit(FEATURES)), F.transform(_class_words(F.col("text")), _cell))
    counted = rated.select("label", F.explode(cells).alias("cell")).groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros((FEATURES + 1, len(CLASSES)))
    for r in counted.collect():
        counts[r["cell"], r["label"]] = r["n"]
    priors = np.log((counts[-1] + smooth) / (counts[-1].sum() + smooth * len(CLASSES)))
    shares = np.log((counts[:-1] + smooth) / (counts[:-1].sum(axis=0) + smooth * FEATURES))
    return [tuple(row) for row in np.vstack([priors, shares]).tolist()]


def count_scores(model: list[tuple[float, ...]], df: DataFrame, id_col: str = "Id", text_col: str = "Text") -> DataFrame:
    """(id, neg, neu, pos) of every row by `fit_count_classifier`; NULL scores where `rejection` refuses the text.

    The model is a constant of the plan and a text is folded over it inside its row.
    """
    table = F.from_json(F.lit(json.dumps([list(row) for row in model[1:]])), "array<array<double>>")
    start = F.array(*[F.lit(v) for v in model[0]])

    def add(total: Column, cell: Column) -> Column:
        return F.zip_with(total, F.get(table, cell), lambda a, b: a + b)

    words = F.transform(_class_words(F.col(text_col)), _cell)
    logits = df.select(id_col, F.when(rejection(F.col(text_col)).isNull(), F.aggregate(words, start, add)).alias("z"))
    p = logits.select(id_col, softmax(F.col("z")).alias("p"))
    return p.select(id_col, *[F.col("p")[i].alias(c) for i, c in enumerate(CLASSES)])


def joint_scores(lexicon_scores: DataFrame, model: DataFrame, reviews: DataFrame, id_col: str = "Id") -> DataFrame:
    """Both scorers side by side under prefixed names, with the review columns."""
    left = prefix_columns(lexicon_scores, "lexicon_", [id_col])
    right = prefix_columns(model, "model_", [id_col])
    return natural_left_join(left.join(right, id_col), reviews)


def lexicon_class(compound: Column, band: float = 0.05) -> Column:
    return F.when(compound >= band, "pos").when(compound <= -band, "neg").otherwise("neu")


def model_class(neg: Column, neu: Column, pos: Column) -> Column:
    """Most likely class; of equal ones the first of neg, neu, pos."""
    return F.when((neg >= neu) & (neg >= pos), "neg").when(neu >= pos, "neu").otherwise("pos")


def with_classes(joint: DataFrame) -> DataFrame:
    return joint.withColumns(
        {
            "lexicon_class": lexicon_class(F.col("lexicon_compound")),
            "model_class": model_class(F.col("model_neg"), F.col("model_neu"), F.col("model_pos")),
            "rating_class": rating_class(F.col("Score")),
        }
    )


def confusion(joint: DataFrame) -> DataFrame:
    return with_classes(joint).groupBy("lexicon_class", "model_class").agg(F.count(F.lit(1)).alias("n"))


def accuracy(joint: DataFrame) -> DataFrame:
    """(scorer, n, correct, accuracy) over the rated rows."""
    rated = with_classes(joint).where(F.col("rating_class").isNotNull())
    counts = rated.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("lexicon_class") == F.col("rating_class")).alias("lexicon"),
        F.count_if(F.col("model_class") == F.col("rating_class")).alias("model"),
    )
    long = counts.unpivot(["n"], ["lexicon", "model"], "scorer", "correct")
    return long.select("scorer", "n", "correct", F.try_divide("correct", "n").alias("accuracy"))


def top_disagreements(joint: DataFrame, rating: int, score_col: str, k: int = 1, id_col: str = "Id") -> DataFrame:
    """The k rows of one rating that a scorer sees most differently; ties by id."""
    return joint.where(F.col("Score") == rating).orderBy(F.col(score_col).desc(), id_col).limit(k)


def top_per_rating(joint: DataFrame, score_col: str, id_col: str = "Id") -> DataFrame:
    """Highest row by `score_col` of each rating. Each map task keeps one row per rating."""
    order = Window.partitionBy("Score").orderBy(F.col(score_col).desc(), F.col(id_col))
    rated = joint.where(F.col("Score").isNotNull())
    return rated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == 1).drop("rank")


def mean_interval(df: DataFrame, group: str, value: str, z: float = 1.96) -> DataFrame:
    """Mean per group with its normal 95 % interval."""
    stats = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    half = z * F.col("std") / F.sqrt("n")
    return stats.select(group, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def _long(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """(group, variable, value) rows of the measures, rated rows only."""
    rated = df.where(F.col(group).isNotNull()).select(group, *[F.col(v).cast("double").alias(v) for v in values])
    return rated.unpivot([group], list(values), "variable", "value")


def mean_intervals(df: DataFrame, group: str, values: Sequence[str], z: float = 1.96) -> DataFrame:
    """`mean_interval` of several measures in one aggregate: (group, variable, n, mean, low, high)."""
    stats = _long(df, group, values).groupBy(group, "variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    half = z * F.col("std") / F.sqrt("n")
    return stats.select(group, "variable", "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def bootstrap_intervals(df: DataFrame, group: str, values: Sequence[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """`bootstrap_interval` of several measures in one pass: (group, variable, n, mean, low, high)."""
    return _bootstrapped(_long(df, group, values), [group, "variable"], "value", replicates, seed, 0.95)


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """The `step`-th of a key's uniform numbers, in (0, 1)."""
    x = key.astype(np.uint64) + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def _log_factorial(k: np.ndarray) -> np.ndarray:
    """Stirling's series from 16 on, sums of logarithms below: right to 1e-13."""
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, 16.0)))])
    n = np.maximum(k, 16.0)
    series = (n + 0.5) * np.log(n) - n + 0.5 * np.log(2 * np.pi) + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)
    return np.where(k < 16, small[np.minimum(k, 15).astype(int)], series)


INVERTED = 500  # mean below which a draw is an inversion of one uniform number


@F.pandas_udf(DoubleType())
def _poisson(mean: pd.Series, key: pd.Series) -> pd.Series:
    """Poisson draws of any mean: by inversion at the last 52 bits of the key below 500, above by transformed rejection."""
    m, keys = mean.to_numpy(), key.to_numpy().view(np.uint64)
    out = np.zeros(len(m))
    at = np.flatnonzero((m > 0) & (m < INVERTED))
    u, term = ((keys[at] & np.uint64((1 << 52) - 1)).astype(np.float64) + 0.5) / float(1 << 52), np.exp(-m[at])
    below, step = term.copy(), 0
    open_ = u > below
    # a term below 1e-18 no longer moves the distribution function
    while open_.any():
        step += 1
        out[at[open_]] += 1
        term = term * m[at] / step
        below += term
        open_ &= (u > below) & ((term > 1e-18) | (step < m[at]))
    at, step = np.flatnonzero(m >= INVERTED), 0
    while len(at):
        mu = m[at]
        b = 0.931 + 2.53 * np.sqrt(mu)
        a = -0.059 + 0.02483 * b
        u, v = _uniform(keys[at], step) - 0.5, _uniform(keys[at], step + 1)
        us = 0.5 - np.abs(u)
        k = np.floor((2 * a / us + b) * u + mu + 0.43)
        quick = (us >= 0.07) & (v <= 0.9277 - 3.6224 / (b - 2))
        bound = -mu + k * np.log(mu) - _log_factorial(np.maximum(k, 0))
        slow = np.log(v * (1.1239 + 1.1328 / (b - 3.4)) / (a / (us * us) + b)) <= bound
        taken = quick | ((k >= 0) & ~((us < 0.013) & (v > us)) & slow)
        out[at[taken]] = k[taken]
        at, step = at[~taken], step + 2
    return pd.Series(out)


def bootstrap_interval(
    df: DataFrame, group: str, value: str, replicates: int = 1000, seed: int = 0, level: float = 0.95
) -> DataFrame:
    """Mean per group with its Poisson-bootstrap interval.

    Equal values are counted first, and a value that occurs c times is drawn Poisson(c) times
    as a whole, which has the distribution of c single draws. So the replicates multiply the
    distinct values (scores have four decimals), not the rows. Draws come from the MD5 of the
    group, the value to ten decimals, the replicate and the seed: a lost task repeats its draws,
    and another engine can make them too.
    """
    return _bootstrapped(df, [group], value, replicates, seed, level)


def _bootstrapped(df: DataFrame, groups: list[str], value: str, replicates: int, seed: int, level: float) -> DataFrame:
    values = df.where(F.col(groups[0]).isNotNull() & F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("v"))
    counted = values.groupBy(*groups, "v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    drawn = counted.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    shown = [*[F.col(g).cast("string") for g in groups], F.col("v").try_cast("decimal(30,10)").cast("string"), F.col("b").cast("string")]
    digest = F.md5(F.concat_ws(":", *shown, F.lit(str(seed))))
    key = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    weighted = drawn.withColumn("w", _poisson(F.col("c"), key))
    means = weighted.groupBy(*groups, "b").agg(
        F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"),
        F.sum(F.col("c") * F.col("v")).alias("sum_v"),
        F.sum("c").alias("n"),
    )
    tail = (1 - level) / 2
    # One row per replicate: `percentile` holds at most `replicates` values.
    return means.groupBy(*groups).agg(
        F.max("n").cast("long").alias("n"),
        (F.max("sum_v") / F.max("n")).alias("mean"),
        F.percentile("m", F.lit(tail)).alias("low"),
        F.percentile("m", F.lit(1 - tail)).alias("high"),
    )


def quantiles_by_rating(df: DataFrame, value: str, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles per rating. The narrow scored rows are stored, as they are read twice."""
    rated = stored(df.where(F.col("Score").isNotNull()).select("Score", value))
    return exact_quantiles(rated, ["Score"], value, probs)
