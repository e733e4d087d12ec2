"""Ordered operators on many series at once.

Two physical layouts stand behind the same operators, chosen by `Layout.long`:

* short: the rows of a series are bounded by construction (daily bars: one row per day,
  whatever the number of trades). One exchange on the series key serves the index, the lags,
  the splits and the scaling together.
* long: a series may hold any share of all rows, and so may any hour of it. Rows are stored in
  range cuts of (series, time, tie), and each cut starts at the count of the cuts before it,
  taken from a small aggregate. Neighbour operators then run on blocks of consecutive rows,
  each of which also gets copies of the few rows it must look back (or ahead) to. No task
  ever holds a whole series, and no row is left out.

For the second layout the tie-break columns must make the order of a series total.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skarn.operators.joins import join_groups, natural_left_join
from skarn.operators.quantiles import exact_quantiles, one_row_per_group
from skarn.operators.ranges import AT, CUT, carried, ranged


@dataclass(frozen=True)
class Layout:
    """How the rows of a frame make up series.

    key: columns that name the series. time, tie: the order inside a series.
    long: see above. block: rows per block of the neighbour operators.
    """

    key: tuple[str, ...] = ("series_id",)
    time: str = "dt"
    tie: tuple[str, ...] = ()
    long: bool = True
    block: int = 20_000

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tie]


BARS = Layout(long=False)


def row_index(df: DataFrame, layout: Layout) -> DataFrame:
    """Add `row_idx` (0-based position in the series) and `n_rows` (length of the series)."""
    if "row_idx" in df.columns:
        return df
    key = list(layout.key)
    if not layout.long:
        whole = Window.partitionBy(*key)
        position = F.row_number().over(whole.orderBy(*layout.order)) - 1
        return df.withColumns(
            {"row_idx": position.cast("long"), "n_rows": F.count(F.lit(1)).over(whole)}
        )
    rows = ranged(df, [*key, *layout.order])
    sizes = rows.groupBy(*key, CUT).agg(F.count(F.lit(1)).alias("_size"), F.min(AT).alias("_first"))
    cuts = Window.partitionBy(*key)
    before = cuts.orderBy(CUT).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *key,
        CUT,
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_start"),
        F.sum("_size").over(cuts).alias("n_rows"),
    )
    placed = natural_left_join(rows, starts, null_safe=True)
    return placed.withColumn("row_idx", (F.col(AT) + F.col("_start")).cast("long")).select(*df.columns, "row_idx", "n_rows")


def _blocks(df: DataFrame, layout: Layout, back: int, ahead: int) -> tuple[DataFrame, WindowSpec, Column]:
    """Frame, window and own-row mark for an operator that looks `back` and `ahead` rows.

    Each row goes to its own block and to every block that has to see it.
    """
    if not layout.long:
        return df, Window.partitionBy(*layout.key).orderBy("row_idx"), F.lit(True)
    size = max(layout.block, back + ahead, 1)
    own = F.floor(F.col("row_idx") / size)
    first = F.greatest(F.floor((F.col("row_idx") - ahead) / size), F.lit(0))
    last = F.floor((F.col("row_idx") + back) / size)
    copied = df.withColumn("_block", F.explode(F.sequence(first, last)))
    return copied, Window.partitionBy(*layout.key, "_block").orderBy("row_idx"), F.col("_block") == own


def _own_rows(df: DataFrame, mark: Column) -> DataFrame:
    return df.where(mark).drop("_block") if "_block" in df.columns else df


def lags(df: DataFrame, layout: Layout, value: str, n: int) -> DataFrame:
    """Add lag_n .. lag_1 and `prev_time`, all NULL where there is no such row."""
    indexed = row_index(df, layout)
    frame, ordered, mine = _blocks(indexed, layout, back=n, ahead=0)
    added = {f"lag_{k}": F.lag(value, k).over(ordered) for k in range(n, 0, -1)}
    added["prev_time"] = F.lag(layout.time, 1).over(ordered)
    return _own_rows(frame.withColumns(added), mine)


def lag_table(
    df: DataFrame,
    layout: Layout,
    value: str,
    n: int = 3,
    first: object = None,
    last: object = None,
    max_gap_days: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """The supervised table: key, time, lag_n .. lag_1, target, gap_days, row_idx, n_rows.

    Lags are taken before the date filter, so the first wanted row sees the history before
    it. Rows with fewer than n predecessors are left out (`short_history` counts them);
    `strict` raises instead. `max_gap_days` ends each series at its first longer gap.
    """
    with_lags = lags(df.select(*layout.key, *layout.order, value), layout, value, n)
    wanted = with_lags
    if first is not None:
        wanted = wanted.where(F.col(layout.time) >= F.lit(first))
    if last is not None:
        wanted = wanted.where(F.col(layout.time) <= F.lit(last))
    if strict and not wanted.where(F.col("row_idx") < n).isEmpty():
        raise ValueError(f"some rows have fewer than {n} predecessors")
    wanted = wanted.where(F.col("row_idx") >= n).withColumn(
        "gap_days", F.date_diff(F.col(layout.time), F.col("prev_time"))
    )
    if max_gap_days is not None:
        # The gap before the first wanted row belongs to its history, not to the run.
        in_run = F.col("row_idx") > n
        if first is not None:
            in_run = in_run & (F.col("prev_time") >= F.lit(first))
        first_break = F.min(F.when(in_run & (F.col("gap_days") > max_gap_days), F.col(layout.time)))
        if not layout.long:
            wanted = wanted.withColumn("_break", first_break.over(Window.partitionBy(*layout.key)))
        else:
            breaks = wanted.groupBy(*layout.key).agg(first_break.alias("_break"))
            wanted = wanted.join(breaks, list(layout.key), "left")
        wanted = wanted.where(F.col("_break").isNull() | (F.col(layout.time) < F.col("_break"))).drop("_break")
    return wanted.select(
        *layout.key,
        *layout.order,
        *[f"lag_{k}" for k in range(n, 0, -1)],
        F.col(value).alias("target"),
        "gap_days",
        "row_idx",
        "n_rows",
    )


def short_history(df: DataFrame, layout: Layout, n: int, first: object = None, last: object = None) -> DataFrame:
    """Rows per series that `lag_table` leaves out for want of n predecessors."""
    indexed = row_index(df.select(*layout.key, *layout.order), layout)
    wanted = indexed
    if first is not None:
        wanted = wanted.where(F.col(layout.time) >= F.lit(first))
    if last is not None:
        wanted = wanted.where(F.col(layout.time) <= F.lit(last))
    return wanted.groupBy(*layout.key).agg(F.count_if(F.col("row_idx") < n).alias("n_short"))


def lag_arrays(table: DataFrame, layout: Layout, n: int = 3, nested: bool = False) -> DataFrame:
    """Split a lag table into key, time, X (array of float, oldest first) and y (float)."""
    x = F.array(*[F.col(f"lag_{k}") for k in range(n, 0, -1)]).cast("array<float>")
    if nested:
        x = F.transform(x, lambda v: F.array(v))
    extra = [c for c in ("row_idx", "n_rows", "split") if c in table.columns]
    return table.select(
        *layout.key, *layout.order, x.alias("X"), F.col("target").cast("float").alias("y"), *extra
    )


def history(df: DataFrame, layout: Layout, value: str, length: int = 60) -> DataFrame:
    """Add `window`: the `length` values before each row, oldest first. Rows with less are left out.

    A missing value would silently shorten a window and so raises.
    """
    indexed = row_index(df, layout)
    frame, ordered, mine = _blocks(indexed, layout, back=length, ahead=0)
    checked = F.coalesce(F.col(value), F.raise_error(F.lit(f"{value} holds NULL: impute first")).cast("double"))
    frame = frame.withColumn("window", F.collect_list(checked).over(ordered.rowsBetween(-length, -1)))
    return _own_rows(frame, mine & (F.col("row_idx") >= length)).where(F.col("row_idx") >= length)


def next_observation(df: DataFrame, layout: Layout, days: int = 7) -> DataFrame:
    """Add `next_time`, `gap_days` and `within`: is there a next row at most `days` later?"""
    indexed = row_index(df, layout)
    frame, ordered, mine = _blocks(indexed, layout, back=0, ahead=1)
    frame = frame.withColumn("next_time", F.lead(layout.time, 1).over(ordered))
    gap = F.date_diff(F.col("next_time"), F.col(layout.time))
    return _own_rows(frame, mine).withColumns({"gap_days": gap, "within": F.coalesce(gap <= days, F.lit(False))})


def asof(probes: DataFrame, facts: DataFrame, layout: Layout, values: Sequence[str]) -> DataFrame:
    """For each probe (key, time, ...) the last fact at or before it, as fact_time and `values`.

    Probes and facts are stacked and the last fact is carried forward, so the work is one sort.
    Long series are carried inside range cuts, each of which starts from the last fact of the
    cuts before it.
    """
    key = list(layout.key)
    extra = [c for c in probes.columns if c not in key and c != layout.time]
    fact = F.struct(F.col(layout.time).alias("fact_time"), *values)
    fact_type = facts.select(fact.alias("s")).schema["s"].dataType
    tie = F.struct(*layout.tie) if layout.tie else F.lit(0)
    extra_struct = F.struct(*extra) if extra else F.struct(F.lit(0).alias("none"))
    extra_type = probes.select(extra_struct.alias("s")).schema["s"].dataType
    tie_type = facts.select(tie.alias("t")).schema["t"].dataType
    stacked = facts.select(
        *key, layout.time, tie.alias("_tie"), F.lit(0).alias("_probe"), fact.alias("_fact"),
        F.lit(None).cast(extra_type).alias("_extra"),
    ).unionByName(
        probes.select(
            *key, layout.time, F.lit(None).cast(tie_type).alias("_tie"), F.lit(1).alias("_probe"),
            F.lit(None).cast(fact_type).alias("_fact"), extra_struct.alias("_extra"),
        )
    )
    order = [layout.time, "_probe", "_tie"]
    if layout.long:
        asked = carried(stacked, [*key, *order], key, "_fact", [layout.time, "_extra"])
    else:
        upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        asked = stacked.withColumn("_last", F.last("_fact", ignorenulls=True).over(upto)).where(F.col("_probe") == 1)
    return asked.select(
        *key,
        layout.time,
        *[F.col(f"_extra.{c}").alias(c) for c in extra],
        F.col("_last.fact_time").alias("fact_time"),
        *[F.col(f"_last.{v}").alias(v) for v in values],
    )


def series_names(df: DataFrame, column: str = "series_id", most: int = 10_000) -> list[str]:
    """The names of the series that `df` holds, in order; more than `most` of them are refused."""
    names = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} series")
    return sorted(names)


def last_k(df: DataFrame, layout: Layout, k: int) -> DataFrame:
    """Last k rows of each series. Each map task keeps k rows per series before the exchange."""
    newest = Window.partitionBy(*layout.key).orderBy(*[F.col(c).desc() for c in layout.order])
    return df.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k)


def split_chronological(df: DataFrame, layout: Layout, train: float = 0.8, val: float = 0.9) -> DataFrame:
    """Add `split`: train below int(n * train), val below int(n * val), then test."""
    indexed = row_index(df, layout)
    at, n = F.col("row_idx"), F.col("n_rows")
    return indexed.withColumn(
        "split",
        F.when(at < F.floor(n * F.lit(train)), "train").when(at < F.floor(n * F.lit(val)), "val").otherwise("test"),
    )


def split_holdout(df: DataFrame, layout: Layout, train: float = 0.95) -> DataFrame:
    """Add `split`: train below ceil(n * train), then test.

    Windows are taken before the split, so test rows look back into the training part.
    """
    indexed = row_index(df, layout)
    return indexed.withColumn(
        "split", F.when(F.col("row_idx") < F.ceil(F.col("n_rows") * F.lit(train)), "train").otherwise("test")
    )


def fit_scaler(df: DataFrame, key: Sequence[str], value: str, where: Column | None = None) -> DataFrame:
    """Mean, population std, min and max per series, over the rows that satisfy `where`."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*key).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )


def with_scaler(df: DataFrame, layout: Layout, value: str, where: Column | None = None) -> DataFrame:
    """Add mean, std, low and high of the series, taken over the rows that satisfy `where`.

    Bounded series use the exchange that their index and splits already need; others get
    the statistics from an aggregate that combines on the map side.
    """
    if layout.long:
        return join_groups(df, fit_scaler(df, layout.key, value, where), layout.key, "left")
    whole = Window.partitionBy(*layout.key)
    used = F.col(value) if where is None else F.when(where, F.col(value))
    return df.withColumns(
        {
            "mean": F.avg(used).over(whole),
            "std": F.stddev_pop(used).over(whole),
            "low": F.min(used).over(whole),
            "high": F.max(used).over(whole),
        }
    )


def outlier_flags(df: DataFrame, key: str, value: str, reach: float = 1.5) -> DataFrame:
    """Add q1, q3 and `is_outlier`: outside [q1 - reach * iqr, q3 + reach * iqr] of its series."""
    quartiles = exact_quantiles(df, [key], value, (0.25, 0.75))
    fences = one_row_per_group(quartiles, [key], {0.25: "q1", 0.75: "q3"}).drop("n")
    iqr = F.col("q3") - F.col("q1")
    outside = (F.col(value) < F.col("q1") - reach * iqr) | (F.col(value) > F.col("q3") + reach * iqr)
    return join_groups(df, fences, [key], "left").withColumn("is_outlier", outside)


def downsample(df: DataFrame, layout: Layout, unit: str = "month") -> DataFrame:
    """Bars of a coarser unit from bars: open, high, low, close, average close and total volume."""
    rank = F.struct(*layout.order)
    return df.groupBy(*layout.key, F.to_date(F.date_trunc(unit, F.col(layout.time))).alias("bucket")).agg(
        F.min_by("open", rank).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", rank).alias("close"),
        F.avg("close").alias("avg_close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("n_bars"),
    )
