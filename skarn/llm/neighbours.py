"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A vector is turned by three rounds of random signs and a Hadamard transform; its hash is the axis (with sign) on which it
then lies longest. A bucket joins `FUNCTIONS` such hashes, and there are `TABLES` tables. A vector lies in its own bucket
of each table and probes all buckets that take the best or second best axis of each hash: a pair is a candidate when one
of the two probes the other's bucket. A pair at a cosine of 0.93 in 64 dimensions is missed with a probability of about
2 in 10,000, closer ones less often; every candidate is verified on whole vectors in double precision.

Before that, close vectors are gathered into balls: a leader and vectors within half the angle of the threshold, all of
which link with each other. Balls are made in chunks of bounded size dealt by bucket and a salt, so a group of copies that
holds a large part of all rows becomes a number of full balls spread over tasks. Buckets then hold balls, not vectors; two
balls whose leaders are close enough link as a whole, and only in between are their vectors compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm._shared import stored
from skarn.llm.components import connected
from skarn.llm.shingles import mix

COSINE = 0.93
TABLES, FUNCTIONS = 12, 3
SALTS = 64  # parts into which a bucket is dealt before balls are made
CHUNK = 2048  # vectors among which leaders are chosen, and so the most a ball holds
TILE = 256  # rows of a ball compared at once
SLACK = 1e-7  # radians within which a whole-ball decision is left to the vectors


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times a normed Hadamard matrix; the row length is a power of two."""
    n = x.shape[1]
    h = 1
    while h < n:
        pair = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def polytope(units: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Best and second best signed axis of each row under one rotation; a single axis has only its sign."""
    n = 1 << max(0, units.shape[1] - 1).bit_length()
    x = np.zeros((len(units), n))
    x[:, : units.shape[1]] = units
    signs = np.random.default_rng([7, seed, n]).choice([-1.0, 1.0], (3, n))
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    rows = np.arange(len(x))
    best = size.argmax(axis=1)
    first = 2 * best + (x[rows, best] > 0)
    size[rows, best] = -1
    second = size.argmax(axis=1)
    return first, 2 * second + (x[rows, second] > 0)


def buckets(units: np.ndarray, table: int) -> np.ndarray:
    """For each row the codes of its 2^FUNCTIONS buckets of one table, its own bucket first."""
    codes = np.zeros((len(units), 1), np.uint64)
    for k in range(FUNCTIONS):
        both = np.stack(polytope(units, table * FUNCTIONS + k), axis=1).astype(np.uint64)
        wide = 2 << max(0, units.shape[1] - 1).bit_length()
        codes = (both[:, :, None] + codes[:, None, :] * np.uint64(wide)).reshape(len(units), -1)
    return codes


def _units(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(usable rows, their unit vectors): not null, finite throughout, not zero."""
    flat = pc.cast(column.flatten(), pa.float64())
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    values = flat.fill_null(np.nan).to_numpy()
    ends = np.cumsum(sizes)
    good, units = [], []
    for k in np.flatnonzero(sizes):
        v = values[ends[k] - sizes[k] : ends[k]]
        top = np.abs(v).max()
        if np.isfinite(top) and top > 0:
            v = v / top  # no overflow in the norm
            good.append(k)
            units.append(v / np.sqrt((v * v).sum()))
    return np.array(good, np.int64), units


UNITS = "vec_id long, label long, dim int, cell long, unit binary"


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, units = _units(batch.column("embedding"))
        dims = np.array([len(u) for u in units], np.int32)
        cells = np.zeros(len(units), np.int64)
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            cells[own] = buckets(np.stack([units[k] for k in own]), 0)[:, 0].view(np.int64)
        rows = pa.array(good)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id").cast(pa.int64()).take(rows),
                batch.column("label").cast(pa.int64()).take(rows),
                pa.array(dims),
                pa.array(cells),
                pa.array([u.tobytes() for u in units], pa.binary()),
            ],
            ["vec_id", "label", "dim", "cell", "unit"],
        )


BALLS = "ball long, label long, dim int, n long, angle double, ids binary, units binary"


def _led(ids: np.ndarray, units: np.ndarray, half: float) -> Iterator[tuple[np.ndarray, float]]:
    """Rows of each ball, leader first, and the largest angle from the leader."""
    free = np.arange(len(ids))
    while len(free):
        cosine = units[free] @ units[free[0]]
        cosine[0] = 1.0
        near = cosine >= half
        yield free[near], float(np.arccos(np.clip(cosine[near].min(), -1, 1)))
        free = free[~near]


def _balls(half: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, units, rows = None, [], [], []

        def close() -> None:
            if not ids:
                return
            own, x = np.array(ids, np.int64), np.stack([np.frombuffer(u) for u in units])
            for at, angle in _led(own, x, half):
                rows.append((int(own[at[0]]), key[0], key[1], len(at), angle, own[at].tobytes(), x[at].tobytes()))
            ids.clear()
            units.clear()

        def table() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["ball", "label", "dim", "n", "angle", "ids", "units"])

        for batch in batches:
            heads = zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "cell", "salt")), strict=True)
            for now, vec, unit in zip(heads, batch.column("vec_id").to_pylist(), batch.column("unit").to_pylist(), strict=True):
                if now != key or len(ids) >= CHUNK:
                    close()
                    key = now
                ids.append(vec)
                units.append(unit)
            if len(rows) >= 1000:
                yield table()
        close()
        if rows:
            yield table()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ball, own): the buckets of each ball's vectors, each once; `own` where one of them lies."""
    for batch in batches:
        n, dims = batch.column("n").to_numpy(), batch.column("dim").to_numpy()
        labels, names = batch.column("label").to_numpy(), batch.column("ball").to_numpy()
        units = batch.column("units")
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = np.concatenate([np.frombuffer(units[int(k)].as_buffer()) for k in at]).reshape(-1, dim)
            ball = np.repeat(at, n[at])
            for t in range(TABLES):
                codes = buckets(x, t)
                codes = mix(codes + mix(labels[ball].astype(np.uint64) * np.uint64(TABLES) + np.uint64(t))[:, None] + np.uint64(dim))
                own = np.zeros(codes.shape, bool)
                own[:, 0] = True
                flat, who, own = codes.ravel(), np.repeat(ball, codes.shape[1]), own.ravel()
                order = np.lexsort((~own, who, flat))
                flat, who, own = flat[order], who[order], own[order]
                first = np.concatenate(([True], (flat[1:] != flat[:-1]) | (who[1:] != who[:-1])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[first].view(np.int64)), pa.array(names[who[first]]), pa.array(own[first])],
                    ["key", "ball", "own"],
                )


FOUND = "a long, b long, whole boolean, vec_id long, n long"


def _verified(cosine: float):
    theta = float(np.arccos(cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("a", "b", "an", "bn", "aa", "ba", "dim")}
            out = []
            for k in range(batch.num_rows):
                dim = int(c["dim"][k])
                x = np.frombuffer(batch.column("au")[k].as_buffer()).reshape(-1, dim)
                y = np.frombuffer(batch.column("bu")[k].as_buffer()).reshape(-1, dim)
                between = float(np.arccos(np.clip(x[0] @ y[0], -1, 1)))
                reach = c["aa"][k] + c["ba"][k]
                a, b = int(c["a"][k]), int(c["b"][k])
                if len(x) * len(y) > 1 and between + reach < theta - SLACK:
                    out.append((a, b, True, None, None))
                elif between - reach <= theta + SLACK:
                    xs, ys = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                    for i in range(0, len(x), TILE):
                        linked = x[i : i + TILE] @ y.T >= cosine
                        xs[i : i + TILE] = linked.sum(axis=1)
                        ys += linked.sum(axis=0)
                    for name, counts in (("ai", xs), ("bi", ys)):
                        ids = np.frombuffer(batch.column(name)[k].as_buffer(), np.int64)
                        some = np.flatnonzero(counts)
                        out += [(a, b, False, i, j) for i, j in zip(ids[some].tolist(), counts[some].tolist(), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["a", "b", "whole", "vec_id", "n"])

    return run


def near_vectors(df: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; those with equal labels and a cosine of at least `cosine` link.

    A vector that is null, empty or zero, or holds a null or a value that is not finite, links with nothing, as does one
    with a null label; vectors of different length do not link. Rows that repeat an id count once, the smallest by label
    and values; equal vectors under different ids link. Rows without an id give one row without links or component, not
    kept. An empty table gives no rows; other columns are not read.
    """
    every = (
        df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("embedding"))
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "embedding")).alias("v"))
        .select("vec_id", "v.label", "v.embedding")
    )
    units = every.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(_prepared, UNITS)
    key = ["label", "dim", "cell", "salt"]
    half = float(np.cos(np.arccos(cosine) / 2 - 1e-6))
    balls = stored(
        units.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
        .repartition(*key)
        .sortWithinPartitions(*key, "vec_id")
        .mapInArrow(_balls(half), BALLS),
        "balls",
        "lz4",
    )
    keys = stored(balls.select("ball", "label", "dim", "n", "units").mapInArrow(_keys, "key long, ball long, own boolean"), "buckets")
    owned = keys.where("own").select("key", F.col("ball").alias("x"))
    pairs = (
        keys.select("key", F.col("ball").alias("y"))
        .join(owned, "key")
        .where("x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    left, right = (
        balls.select(*[F.col(c).alias(n) for c, n in zip(("ball", "label", "dim", "n", "angle", "ids", "units"), names, strict=True)])
        for names in (("a", "label", "dim", "an", "aa", "ai", "au"), ("b", "label", "dim", "bn", "ba", "bi", "bu"))
    )
    found = stored(pairs.join(left, "a").join(right, ["b", "label", "dim"]).mapInArrow(_verified(cosine), FOUND), "links")
    roots = connected(found.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    # whole balls: each vector of one links with each of the other
    sizes = balls.select(F.col("ball"), "n")
    whole = found.where("whole").select("a", "b")
    beside = (
        whole.select(F.col("a").alias("x"), F.col("b").alias("ball"))
        .union(whole.select(F.col("b").alias("x"), F.col("a").alias("ball")))
        .join(sizes, "ball")
        .groupBy(F.col("x").alias("ball"))
        .agg(F.sum("n").alias("whole"))
    )
    single = found.where("not whole").groupBy("vec_id").agg(F.sum("n").alias("single"))
    member = (
        balls.select("ball", "n", "ids")
        .mapInArrow(_members, "ball long, n long, vec_id long")
        .join(beside, "ball", "left")
        .join(roots.select(F.col("node").alias("ball"), "root"), "ball", "left")
        .select("vec_id", F.coalesce("root", "ball").alias("root"), (F.col("n") - 1 + F.coalesce("whole", F.lit(0))).alias("inside"))
    )
    placed = stored(member, "placed")
    firsts = placed.groupBy("root").agg(F.min("vec_id").alias("component"))
    joined = every.select("vec_id").join(placed.join(firsts, "root"), "vec_id", "left").join(single, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        (F.coalesce("inside", F.lit(0)) + F.coalesce("single", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("n").to_numpy()
        ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.int64)
        balls = np.repeat(batch.column("ball").to_numpy(), n)
        yield pa.RecordBatch.from_arrays([pa.array(balls), pa.array(np.repeat(n, n)), pa.array(ids)], ["ball", "n", "vec_id"])
