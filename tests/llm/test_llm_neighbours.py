"""Near-duplicate vectors against all pairs in double precision."""

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from skarn.llm import neighbours
from skarn.llm._shared import ship

SCHEMA = StructType(
    [StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("label", IntegerType()), StructField("ball", StringType())]
)


def brute(rows):
    usable = {}
    for k, v, label in rows:
        ok = v is not None and len(v) and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok and k is not None:
            x = np.array(v, float) / np.abs(v).max()
            usable[k] = (label, x / np.linalg.norm(x))
    root, links = {k: k for k, _, _ in rows}, {k: 0 for k, _, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(usable)
    for a in ids:
        for b in ids:
            (la, x), (lb, y) = usable[a], usable[b]
            if b < a and la == lb and len(x) == len(y) and x @ y >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((k, links[k], find(k) if k is not None else None, k is not None and find(k) == k) for k in root), key=str)


def ours(spark, rows):
    ship(spark)
    df = spark.createDataFrame([(k, v, label, "x") for k, v, label in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in neighbours.near_vectors(df).collect()), key=str)


def clustered(seed, dim, n):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if k % 3 and rows:
            base = np.array(rows[rng.integers(len(rows))][1])
            base = base + rng.normal(size=dim) * np.linalg.norm(base) / np.sqrt(dim) * rng.choice([0, 0.05, 0.2, 0.35])
        else:
            base = rng.normal(size=dim) * 10.0 ** rng.integers(-3, 4)
        rows.append((int(k * 7 % 1009), base.tolist(), int(rng.integers(2))))
    return rows


@pytest.mark.parametrize("dim,chunk", [(64, 2048), (48, 16), (3, 2048), (1, 5)])
def test_matches_brute_force(spark, monkeypatch, dim, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    rows = clustered(dim, dim, 240)
    got, want = ours(spark, rows), brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert found >= 0.98 * there if dim < 48 else got == want


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, v, 0), (2, [2 * x for x in v], 0), (3, v, None), (4, None, 0), (5, [0.0] * 4, 0), (6, [1.0, None, 3.0, 4.0], 0),
        (7, [1.0, float("nan"), 3.0, 4.0], 0), (8, [float("inf")] + v[1:], 0), (9, v + [0.0], 0), (10, v, 1), (11, [], 0),
        (12, [1e300 * x for x in v], 0), (13, [1e-300 * x for x in v], 0), (None, v, 0),
    ]
    got = ours(spark, rows)
    assert got == brute(rows)
    assert (1, 3, 1, True) in got and (12, 3, 1, False) in got


def test_repeated_id_counts_once_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    assert ours(spark, [(1, v, 0), (1, v, 0), (2, v, 0)]) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert ours(spark, []) == []
