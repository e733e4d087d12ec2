"""Exact interpolated quantiles of big groups.

The built-in `percentile` keeps every distinct value of a group in the memory of one task.
Here a mergeable sketch first brackets each wanted rank to a thin slice of the values. While a
slice may hold more than `most` of them, a further pass counts what lies around it and brackets
the rank anew among its own values, so a slice shrinks to a fortieth with each. Only slices of
a fixed size are ordered, inside a row; what lies outside enters as a count and its nearest
value, and a rank that lay outside its slice would be an error, not a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators.joins import join_groups, natural_left_join
from skarn.sources.files import stored

SLICE = 10_000  # values between the ends of a slice that are ordered in one row
GRID = 200  # parts into which a further pass cuts a slice
GRID_ACCURACY = 10 * GRID  # its sketch is off by at most a tenth of a part
REACH = 1  # parts on either side of the wanted one


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Sequence[float],
    accuracy: int = 10_000,
    also: Sequence[Column] = (),
    most: int = SLICE,
) -> DataFrame:
    """One row per group and probability: (*groups, prob, quantile, n, *also).

    Linear interpolation between the two neighbouring order statistics. Rows with a NULL or
    NaN value, or a NULL group, are left out. `also` are further aggregates of the value,
    named `_v` in them, that ride along on the first of the passes over the input: two for
    groups of up to `most` * `accuracy` / 6 values, one more for each factor of 40 beyond.
    What is shuffled: one row per map task and group, and the distinct values inside the slices.

    The result is exact. The sketch is off by at most n / accuracy ranks and the bracket
    reaches twice as far; when n is so small that this is less than one rank, the sketch
    itself is exact and a wanted rank is at most one place outside the bracket, which is
    the nearest value kept there.
    """
    groups = list(groups)
    clean = df.select(*groups, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    for g in groups:
        clean = clean.where(F.col(g).isNotNull())
    margin = 2.0 / accuracy
    cuts = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    sketch = clean.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", cuts, accuracy).alias("cuts"), *also
    )
    carried = [c for c in sketch.columns if c not in groups and c != "cuts"]
    held = F.ceil(F.col("n") * (3 * margin)).cast("long")
    slices = stored(
        sketch.select(
            *groups,
            *carried,
            F.slice("cuts", 1, len(probs)).alias("lo"),
            F.slice("cuts", len(probs) + 1, len(probs)).alias("hi"),
            F.array_repeat(held, len(probs)).alias("held"),
        )
    )
    while (slices.agg(F.max(F.array_max("held"))).first()[0] or 0) > max(most, 16):
        slices = stored(_narrowed(clean, slices, groups, carried, probs))
    return _ordered(clean, slices, groups, carried, probs)


def _ranks(prob: float) -> tuple[Column, Column]:
    """The places, from 0, of the two order statistics between which a quantile lies."""
    rank = F.lit(prob) * (F.col("n") - 1)
    return F.floor(rank), F.ceil(rank)


def _narrowed(clean: DataFrame, slices: DataFrame, groups: list[str], carried: list[str], probs: Sequence[float]) -> DataFrame:
    """The slices with nearer ends: one pass that counts around each and sketches what lies between its ends."""
    parts = [k / GRID for k in range(GRID + 1)]
    measures = []
    for i in range(len(probs)):
        lo, hi = F.col("lo")[i], F.col("hi")[i]
        measures += [
            F.count_if(F.col("_v") <= lo).alias(f"upto_{i}"),
            F.count_if(F.col("_v") < hi).alias(f"below_{i}"),
            F.percentile_approx(F.when((F.col("_v") > lo) & (F.col("_v") < hi), F.col("_v")), parts, GRID_ACCURACY).alias(f"grid_{i}"),
        ]
    counted = join_groups(clean, slices.select(*groups, "lo", "hi"), groups).groupBy(*groups).agg(*measures)
    both = natural_left_join(slices, counted) if groups else slices.join(F.broadcast(counted))
    lows, highs, held = [], [], []
    for i, prob in enumerate(probs):
        first, second = _ranks(prob)
        lo, hi, upto, below, grid = (F.col("lo")[i], F.col("hi")[i], F.col(f"upto_{i}"), F.col(f"below_{i}"), F.col(f"grid_{i}"))
        inside = below - upto
        # the parts of the grid in which the two places lie, widened
        left = F.floor((first - upto) / inside * GRID) - REACH
        right = F.floor((second - upto) / inside * GRID) + 1 + REACH
        at_low, at_high = second < upto, first >= below
        settled = (inside <= 0) | at_low | at_high
        lows.append(F.when(at_high, hi).when(settled | (left < 0), lo).otherwise(F.get(grid, F.greatest(left, F.lit(0)).cast("int"))))
        highs.append(F.when(at_low, lo).when(settled | (right > GRID), hi).otherwise(F.get(grid, F.least(right, F.lit(GRID)).cast("int"))))
        thin = F.ceil(inside * ((2 * REACH + 3) / GRID + 2 / GRID_ACCURACY)) + 2
        held.append(F.when(settled, 0).otherwise(F.least(inside, thin)).cast("long"))
    return both.select(*groups, *carried, F.array(*lows).alias("lo"), F.array(*highs).alias("hi"), F.array(*held).alias("held"))


def _ordered(clean: DataFrame, slices: DataFrame, groups: list[str], carried: list[str], probs: Sequence[float]) -> DataFrame:
    # Where a value lies towards each slice: -1 below, 0 inside, 1 above. All values that
    # lie alike and inside no slice become one row per map task.
    sides = {}
    for i in range(len(probs)):
        lo, hi = F.col("lo")[i], F.col("hi")[i]
        sides[f"side_{i}"] = F.when(F.col("_v") < lo, -1).when(F.col("_v") > hi, 1).otherwise(0)
    inside = F.lit(False)
    for name in sides:
        inside = inside | (F.col(name) == 0)
    placed = (
        join_groups(clean, slices.drop("held"), groups)
        .withColumns(sides)
        .groupBy(*groups, *carried, *sides, F.when(inside, F.col("_v")).alias("inside"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    )
    by_prob = placed.select(
        *groups,
        *carried,
        "c",
        "least",
        "most",
        F.inline(
            F.array(*[F.struct(F.lit(p).alias("prob"), F.col(f"side_{i}").alias("side")) for i, p in enumerate(probs)])
        ),
    )
    keys = [*groups, "prob", *carried]
    steps = by_prob.groupBy(*keys, "side", F.when(F.col("side") == 0, F.col("least")).alias("inside")).agg(
        F.sum("c").alias("c"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    side = F.col("side")
    whole = steps.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(side == -1, F.col("c"))), F.lit(0)).alias("below"),
        F.max(F.when(side == -1, F.col("most"))).alias("under"),
        F.min(F.when(side == 1, F.col("least"))).alias("over"),
        F.sort_array(F.collect_list(F.when(side == 0, F.struct(F.col("inside").alias("v"), "c")))).alias("slice"),
    )
    rank = F.col("prob") * (F.col("n") - 1)
    low, high = _at(F.floor(rank)), _at(F.ceil(rank))
    ends = whole.select(*keys, low.alias("low"), high.alias("high"))
    between = F.col("low") + (F.col("high") - F.col("low")) * (rank - F.floor(rank))
    quantile = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between)  # also where both are infinite
    return ends.select(*groups, "prob", quantile.alias("quantile"), *carried)


def _at(place: Column) -> Column:
    """The value at a place of the group: in the slice, or the nearest one on either side of it."""
    none = F.lit(None).cast("double")
    start = F.struct(F.col("below").alias("upto"), none.alias("v"))

    def step(acc: Column, x: Column) -> Column:
        upto = acc["upto"] + x["c"]
        return F.struct(upto.alias("upto"), F.when(acc["v"].isNull() & (place < upto), x["v"]).otherwise(acc["v"]).alias("v"))

    total = F.aggregate("slice", F.col("below"), lambda acc, x: acc + x["c"])
    outside = F.when(place == F.col("below") - 1, F.col("under")).when(place == total, F.col("over"))
    found = F.when((place >= F.col("below")) & (place < total), F.aggregate("slice", start, step, lambda acc: acc["v"])).otherwise(outside)
    return F.coalesce(found, F.raise_error(F.lit("a rank lies outside its slice")).cast("double"))


def one_row_per_group(quantiles: DataFrame, groups: Sequence[str], names: dict[float, str]) -> DataFrame:
    """Turn the rows of `exact_quantiles` into one column per probability."""
    rest = [c for c in quantiles.columns if c not in (*groups, "prob", "quantile")]
    return quantiles.groupBy(*groups, *rest).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for p, name in names.items()]
    )
