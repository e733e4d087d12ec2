"""The k best of each query, kept while shards of candidates pass by, and the waves in which the shards come."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query long, score long, id long"
WAVES = (1, 9)  # of 64 parts: the first 1 in wave 0, the next 8 in wave 1, the others in wave 2


def wave_of(*key: str) -> Column:
    """0, 1 or 2: later waves are larger, and set off from the kth scores of those before."""
    part = F.pmod(F.xxhash64(*key), F.lit(64))
    return F.when(part < WAVES[0], 0).when(part < WAVES[1], 1).otherwise(2)


class Best:
    """Running `k` best (score, id) of `n` queries: highest score first, then smallest id, null ids last.

    `floor` holds the score that a candidate must reach to matter, from the start the one given.
    """

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.n, self.k, self.floor = n, k, floor.astype(np.int64).copy()
        self.query = np.zeros(0, np.int64)
        self.score, self.ids, self.none = self.query, self.query, np.zeros(0, bool)

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Take in candidates (position of the query, score, id, whether the id is null)."""
        if not len(query):
            return
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids, none = np.concatenate([self.ids, ids]), np.concatenate([self.none, none])
        order = np.lexsort((ids, none, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[rank < self.k]
        query, last = query[rank < self.k], (rank == self.k - 1)[rank < self.k]
        self.query, self.score, self.ids, self.none = query, score[order], ids[order], none[order]
        self.floor[query[last]] = np.maximum(self.floor[query[last]], self.score[last])

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        """What is held, as rows of `FOUND`; `names` are the queries' keys."""
        return pa.RecordBatch.from_arrays(
            [pa.array(names[self.query]), pa.array(self.score), pa.array(self.ids, mask=self.none)], ["query", "score", "id"]
        )


def k_best(found: DataFrame, k: int, by: Sequence[str] = ("query",)) -> DataFrame:
    """Rows of `FOUND` with `rank`, the k best of each query; each map task keeps k of a query before the exchange."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def floors(found: DataFrame, k: int, names: np.ndarray, least: int) -> np.ndarray:
    """kth score of each query of one block (`least` where it has fewer), for the next wave; one number a query."""
    out = np.full(len(names), least, np.int64)
    order = np.argsort(names)
    rows = found.where(F.col("rank") == k).select("query", "score").toArrow()
    at = order[np.searchsorted(names, rows.column("query").to_numpy(), sorter=order)] if rows.num_rows else []
    out[at] = rows.column("score").to_numpy()
    return out
