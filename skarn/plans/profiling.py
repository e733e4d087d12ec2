"""Inspection, projection and predicate queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from skarn.functions import dates
from skarn.operators import columns, profile
from skarn.sources import views
from skarn.sources.files import spread


def _rounded(df, names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


def preview(spark, sf_dir):
    return profile.preview(views.customers(spark, sf_dir), "id", 5)


def table_shape(spark, sf_dir):
    return profile.shape(views.customers(spark, sf_dir))


def column_profile(spark, sf_dir):
    """Of texts with their ratings; what crosses the join is which columns have a value, not the texts."""
    shown = views.rated(spark, sf_dir, profile.presence(views.language_texts(spark, sf_dir), ["Id"]))
    return profile.column_profile(shown, views.reviews(spark, sf_dir).dtypes)


def null_counts(spark, sf_dir):
    return profile.null_counts(views.rated(spark, sf_dir, profile.presence(views.language_texts(spark, sf_dir), ["Id"], nan=False)))


def _line_numbers(spark, sf_dir):
    return spread(columns.project_numeric(views.table(spark, sf_dir, "lineitem")), "l_orderkey")


def describe_numeric(spark, sf_dir):
    out = profile.describe_numeric(_line_numbers(spark, sf_dir))
    return _rounded(out, ["mean", "std", "min", "q25", "q50", "q75", "max"], 4)


def correlation_matrix(spark, sf_dir):
    return _rounded(profile.correlation_matrix(_line_numbers(spark, sf_dir)), ["r"])


def project_named(spark, sf_dir):
    return views.prices(spark, sf_dir).select("series_id", "dt", "close")


def project_positional(spark, sf_dir):
    return columns.project_positional(views.customers(spark, sf_dir), [1, 2])


def project_numeric(spark, sf_dir):
    return columns.project_numeric(views.table(spark, sf_dir, "lineitem"))


def review_sample(spark, sf_dir):
    """The first 500 texts; only these meet their ratings."""
    return views.rated(spark, sf_dir, views.language_texts(spark, sf_dir).orderBy("Id").limit(500))


def row_at(spark, sf_dir):
    return columns.row_at(views.texts(spark, sf_dir), "Id", 50)


def filter_by_rating(spark, sf_dir):
    return views.reviews(spark, sf_dir).where(F.col("Score") == 1)


def rating_counts(spark, sf_dir):
    return columns.value_counts(views.ratings(spark, sf_dir), "Score")


def date_range_open(spark, sf_dir):
    return columns.open_interval(views.prices(spark, sf_dir), "dt", dt.date(1996, 1, 1), dt.date(1997, 1, 1))


def date_range_closed(spark, sf_dir):
    return columns.closed_interval(views.prices(spark, sf_dir), "dt", dt.date(1996, 1, 1), dt.date(1997, 1, 1))


def parse_dates(spark, sf_dir):
    source = views.date_text(spark, sf_dir)
    return source.select(
        "id",
        dates.parse_date(F.col("s")).alias("parsed"),
        dates.parse_date(F.col("s"), strict=False).alias("tried"),
        dates.parse_timestamp(F.col("s")).cast("date").alias("general"),
        F.date_add(dates.parse_date(F.col("s")), 7).alias("week_later"),
    )


def date_parts(spark, sf_dir):
    source = views.date_text(spark, sf_dir)
    return source.select("id", *dates.date_parts(dates.parse_date(F.col("s"))))


def dedup_last_wins(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return columns.last_wins(orders, "o_custkey", "o_orderkey")


QUERIES = {
    f.__name__: f
    for f in (
        preview,
        table_shape,
        column_profile,
        null_counts,
        describe_numeric,
        correlation_matrix,
        project_named,
        project_positional,
        project_numeric,
        review_sample,
        row_at,
        filter_by_rating,
        rating_counts,
        date_range_open,
        date_range_closed,
        parse_dates,
        date_parts,
        dedup_last_wins,
    )
}
