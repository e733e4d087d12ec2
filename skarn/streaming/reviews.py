"""The operators that need no other row run unchanged on a stream.

Only such operators are offered here: date parsing, quarantine and model scoring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skarn.operators.scoring import model_scores, quarantine, scorable


def review_stream(spark: SparkSession, folder: str, schema: str = "Id long, Score int, Text string") -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def scored_stream(reviews: DataFrame, make_predict: Callable, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two streams: model scores of the good texts, and the rejected rows with a reason."""
    good = scorable(reviews, max_chars=max_chars)
    return model_scores(good, make_predict), quarantine(reviews, max_chars=max_chars)
