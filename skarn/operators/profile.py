"""Preview, shape, column profile, null counts, description and correlation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from skarn.functions.numeric import missing
from skarn.operators.quantiles import exact_quantiles, one_row_per_group

QUARTILES = {0.25: "q25", 0.5: "q50", 0.75: "q75"}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def preview(df: DataFrame, key: str | Sequence[str], n: int = 5) -> DataFrame:
    """First n rows by key."""
    return df.orderBy(*([key] if isinstance(key, str) else key)).limit(n)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def presence(df: DataFrame, keep: Sequence[str] = (), nan: bool = True) -> DataFrame:
    """Every column but `keep` as true where it has a value, NULL where not; with `nan` also where it is NaN.

    Put below a join, it lets `column_profile` and `null_counts` (with nan=False) count what the
    join would give without moving any value through it.
    """
    shown = []
    for f in df.schema.fields:
        gone = F.col(f.name).isNull() if nan else missing(F.col(f.name), f.dataType)
        shown.append(F.col(f.name) if f.name in keep else F.when(~gone, True).alias(f.name))
    return df.select(*shown)


def column_profile(df: DataFrame, dtypes: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(position, column_name, dtype, non_null), from one pass over the data.

    `dtypes` names the columns and types to report where `df` holds their `presence`.
    """
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"),
                        F.lit(name).alias("column_name"),
                        F.lit(dtype).alias("dtype"),
                        F.col(name).alias("non_null"),
                    )
                    for i, (name, dtype) in enumerate(dtypes or df.dtypes)
                ]
            )
        )
    )


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_missing); NaN counts as missing in floating columns."""
    counts = df.agg(
        *[F.count_if(missing(F.col(f.name), f.dataType)).alias(f.name) for f in df.schema.fields]
    )
    return counts.unpivot([], df.columns, "column_name", "n_missing")


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles and max, one row per numeric column.

    NaN is missing. Two passes over the data: the moments ride along on the first pass of
    the exact quartiles. A column without any value has count 0 and NULL elsewhere.
    """
    columns = list(columns or numeric_columns(df))
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    moments = (
        F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    quartiles = exact_quantiles(long, ["column_name"], "value", list(QUARTILES), also=moments)
    described = one_row_per_group(quartiles, ["column_name"], QUARTILES)
    names = F.explode(F.array(*[F.lit(c) for c in columns]))
    return (
        df.sparkSession.range(1)
        .select(names.alias("column_name"))
        .join(described, "column_name", "left")
        .select(
            "column_name", F.coalesce("n", F.lit(0).cast("long")).alias("count"), "mean", "std", "min", "q25", "q50", "q75", "max"
        )
    )


# More correlations than this in one aggregate make its generated code too long to be compiled.
_PAIRS_PER_AGGREGATE = 14


def _pair_correlations(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(*groups, a, b, r, n) for each unordered pair of columns, in one pass; n counts all rows.

    Each row is handed on once per batch of pairs, and a batch is aggregated as a whole.
    """
    values = df.select(*groups, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    batches = [pairs[i : i + _PAIRS_PER_AGGREGATE] for i in range(0, len(pairs), _PAIRS_PER_AGGREGATE)]
    width = len(batches[0])
    nothing = F.lit(None).cast("double")

    def row(number: int, batch: Sequence[tuple[str, str]]) -> Column:
        sides = []
        for i in range(width):
            x, y = (F.col(batch[i][0]), F.col(batch[i][1])) if i < len(batch) else (nothing, nothing)
            sides += [x.alias(f"x{i}"), y.alias(f"y{i}")]
        return F.struct(F.lit(number).alias("batch"), *sides)

    handed_on = values.select(*groups, F.inline(F.array(*[row(k, batch) for k, batch in enumerate(batches)])))
    wide = handed_on.groupBy(*groups, "batch").agg(
        F.count(F.lit(1)).alias("n"), *[F.corr(f"x{i}", f"y{i}").alias(f"r{i}") for i in range(width)]
    )
    names = [
        F.when(F.col("batch") == k, F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in batch]))
        for k, batch in enumerate(batches)
    ]
    zipped = F.arrays_zip(F.coalesce(*names).alias("p"), F.array(*[F.col(f"r{i}") for i in range(width)]).alias("r"))
    long = wide.select(*groups, "n", F.inline(zipped).alias("p", "r")).where(F.col("p").isNotNull())
    return long.select(*groups, F.col("p.a").alias("a"), F.col("p.b").alias("b"), "r", "n")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of each ordered pair of columns as (a, b, r), pairwise complete.

    A column with itself gives 1.
    """
    columns = list(columns or numeric_columns(df))
    same = F.explode(F.array(*[F.lit(c) for c in columns])).alias("a")
    diagonal = df.sparkSession.range(1).select(same).select("a", F.col("a").alias("b"), F.lit(1.0).alias("r"))
    if len(columns) < 2:
        return diagonal
    half = _pair_correlations(df, [], columns)
    both = F.array(F.struct(F.col("a"), F.col("b"), F.col("r")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("r")))
    return half.select(F.inline(both)).unionByName(diagonal)


def correlation_by(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Correlation of each unordered pair within each group: (group, a, b, r, n)."""
    return _pair_correlations(df, [group], list(columns))
