"""The input views: driver tables brought into the shapes the operators work on.

| view        | shape                                                        |
| ----------- | ------------------------------------------------------------ |
| customers   | id, income, spend, segment                                   |
| reviews     | Id, Score (1, 3, 5 or NULL), Text, lang                      |
| prices      | series_id, dt, open, high, low, close, volume: daily bars    |
| prices_all  | the same for all orders as one series                        |
| hourly      | series_id, dt, hr, open, high, low, close, volume            |
| ticks       | series_id, ts, event_id, value: single events, not bars      |
| date_text   | id, s                                                        |

Bars are built by an aggregate with map-side combining, so a series holds at most one row
per day (or hour) however many orders or events lie behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.numeric import softmax
from skarn.sources.files import literal_table, spread

SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ),
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("id"))
        .agg(F.sum("o_totalprice").alias("total"))
    )
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("income"), F.col("c_mktsegment").alias("segment")
    )
    return people.join(spend, "id", "left").select(
        "id", "income", F.round(F.coalesce("total", F.lit(0.0)) / 1000, 5).alias("spend"), "segment"
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id and Score only: the side that gets joined to scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("Id"), _score())


def language_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("Id"), F.col("text").alias("Text"), "lang")


def rated(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """(Id, Score, Text, lang) of some rows of `language_texts`."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("Id"), _score())
    return docs.join(labels, "Id", "left").select("Id", "Score", "Text", "lang")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir, language_texts(spark, sf_dir))


def rated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Id, Score, Text) of the rated texts only."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("Id"), _score())
    return texts(spark, sf_dir).join(labels, "Id")


def rated_ids(spark: SparkSession, sf_dir: str, rating: int | None = None) -> DataFrame:
    """Id of the rated texts, or of those with one rating, from the labels alone."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("Id"), _score())
    return labels.where(F.col("Score").isNotNull() if rating is None else F.col("Score") == rating).select("Id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id and Text only."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("Id"), F.col("text").alias("Text"))


def scorer_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as input of the scorers: no join comes before the words are reduced."""
    return spread(texts(spark, sf_dir), "Id")


def _score() -> Column:
    return (1 + 2 * F.col("quality") + 2 * (1 - F.col("toxic"))).cast("int").alias("Score")


def _bars(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    # a bare column keeps the aggregate a hash one; a struct would make it sort both halves
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return df.groupBy(*keys).agg(
        F.min_by(value, rank).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, rank).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"),
        F.to_date("o_orderdate").alias("dt"),
        "o_orderkey",
        "o_totalprice",
    )
    return _bars(orders, ["series_id", "dt"], "o_totalprice", ["o_orderkey"])


def prices_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.lit("ALL").alias("series_id"), F.to_date("o_orderdate").alias("dt"), "o_orderkey", "o_totalprice"
    )
    return _bars(orders, ["series_id", "dt"], "o_totalprice", ["o_orderkey"])


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"),
        F.to_date("ts").alias("dt"),
        F.hour("ts").alias("hr"),
        "ts",
        "event_id",
        "value",
    )
    return _bars(events, ["series_id", "dt", "hr"], "value", ["ts", "event_id"])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"), "ts", "event_id", "value"
    )


def date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("s")
    )


# Parameters of the registered queries: the test corpus is invented prose, so its frequent
# words stand in for words with a polarity, a negation and so on.
LEXICON = [
    ("that", 1.5),
    ("with", 2.0),
    ("this", -1.0),
    ("from", -2.5),
    ("rewh", 3.0),
    ("orre", -3.0),
    ("thatin", 0.5),
    ("ononst", -1.5),
    ("worthless", -1.9),
    ("pour", 1.2),
    ("para", -0.8),
    ("nicht", -1.1),
]


def lexicon(spark: SparkSession) -> DataFrame:
    return literal_table(spark, {"token": "string", "valence": "double"}, LEXICON)


def model_logits(text: Column) -> Column:
    """Fixed linear scorer over three text measures, in the place of trained weights."""
    chars = F.length(text) / 1000
    head = F.length(F.substring_index(text, "\n", 1)) / 200
    th = (F.length(text) - F.length(F.replace(text, F.lit("th"), F.lit("")))) * 50 / F.greatest(F.length(text), F.lit(1))
    return F.array(0.8 * chars - 0.5 * th, 0.6 * head, 0.4 * th - 0.3 * chars)


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = scorer_input(spark, sf_dir).select("Id", model_logits(F.col("Text")).alias("z"))
    probs = logits.select("Id", softmax(F.col("z")).alias("p"))
    return probs.select(
        "Id",
        F.round(F.col("p")[0], 6).alias("neg"),
        F.round(F.col("p")[1], 6).alias("neu"),
        F.round(F.col("p")[2], 6).alias("pos"),
    )
