"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Shards form where the rows lie: each task builds a tree over every `SHARD` vectors it reads and stores it, so no vector is
shuffled and a group of copies fills shards like any other rows (equal vectors of a shard are one point with a list of
ids). A node is a ball; no point in it scores more against q than q * centre + |q| * radius. Queries come in blocks of
bounded size. A shard drops the nodes whose bound lies below a query's current kth score, orders the leaves left to each
query by their bound, and scores them in widening rounds, after each of which the kth scores rise. A task carries the kth
scores from shard to shard, and three waves of shards carry them over tasks: 1/64 of the shards, 1/8, the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm._shared import drop_stored, scratch, stored
from skarn.llm.best import FOUND, Best, floors, k_best, wave_of

SCALE = 256.0
SHARD = 16_384  # vectors of a tree
LEAF = 64
BLOCK_BYTES = 8 << 20  # queries searched at a time
LEAST = -(1 << 63)

TREE = "shard string, dim int, points binary, ends binary, ids binary, none binary, centres binary, radii binary, spans binary, children binary"
PARTS = [name.split()[0] for name in TREE.split(", ")]


def integers(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(usable rows, floor(256 * x) of their components): neither null nor empty, finite throughout."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    values = pc.cast(column.flatten(), pa.float64()).fill_null(np.nan).to_numpy()
    ends = np.cumsum(sizes)
    good, out = [], []
    for k in np.flatnonzero(sizes):
        v = values[ends[k] - sizes[k] : ends[k]]
        if np.isfinite(v).all():
            scaled = np.floor(SCALE * v)
            if not np.abs(scaled).max() < 2.0**62:
                raise OverflowError("a component does not fit 64 bits when scaled")
            good.append(k)
            out.append(scaled.astype(np.int64))
    return np.array(good, np.int64), out


def ball_tree(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order of the rows, nodes): centre, radius, rows lo to hi of that order and the two children (-1: a leaf).

    A ball is split between two of its points that lie far apart. Rows must be distinct.
    """
    order = np.arange(len(x))
    centres, radii, spans, children = [], [], [(0, len(x))], [[-1, -1]]
    node = 0
    while node < len(spans):
        lo, hi = spans[node]
        own = x[order[lo:hi]]
        centre = own.mean(axis=0)
        centres.append(centre)
        radii.append(math.sqrt(((own - centre) ** 2).sum(axis=1).max()))
        if hi - lo > LEAF:
            a = ((own - own[0]) ** 2).sum(axis=1).argmax()
            from_a = ((own - own[a]) ** 2).sum(axis=1)
            near = from_a <= ((own - own[from_a.argmax()]) ** 2).sum(axis=1)
            middle = lo + int(near.sum())
            order[lo:hi] = np.concatenate([order[lo:hi][near], order[lo:hi][~near]])
            children[node] = [len(spans), len(spans) + 1]
            spans += [(lo, middle), (middle, hi)]
            children += [[-1, -1], [-1, -1]]
        node += 1
    nodes = {
        "centres": np.array(centres),
        "radii": np.array(radii),
        "spans": np.array(spans, np.int64),
        "children": np.array(children, np.int64),
    }
    return order, nodes


def _tree_row(shard: str, vectors: list[np.ndarray], ids: list[int | None]) -> dict:
    points, at = np.unique(np.stack(vectors), axis=0, return_inverse=True)
    order, nodes = ball_tree(points.astype(np.float64))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[at.ravel()]
    none = np.array([i is None for i in ids])
    ids = np.array([0 if i is None else i for i in ids], np.int64)
    rows = np.lexsort((ids, none, at))
    ends = np.cumsum(np.bincount(at, minlength=len(points)))
    arrays = {"points": points[order], "ends": ends, "ids": ids[rows], "none": none[rows], **nodes}
    return {"shard": shard, "dim": points.shape[1], **{k: v.tobytes() for k, v in arrays.items()}}


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0
    schema = pa.schema([("shard", pa.string()), ("dim", pa.int32()), *[(p, pa.binary()) for p in PARTS[2:]]])
    kept: dict[int, tuple[list, list]] = {}

    def close(dim: int) -> pa.RecordBatch:
        nonlocal made
        vectors, ids = kept.pop(dim)
        made += 1
        return pa.RecordBatch.from_pylist([_tree_row(f"{task}:{made}", vectors, ids)], schema)

    for batch in batches:
        good, vectors = integers(batch.column("embedding"))
        for vec, v in zip(batch.column("vec_id").take(pa.array(good)).to_pylist(), vectors, strict=True):
            own, ids = kept.setdefault(len(v), ([], []))
            own.append(v)
            ids.append(vec)
            if len(own) == SHARD:
                yield close(len(v))
    for dim in list(kept):
        yield close(dim)


class Tree:
    """A stored tree and its search."""

    def __init__(self, row: dict):
        dim = row["dim"]
        whole = {"points": np.int64, "ends": np.int64, "ids": np.int64, "none": bool, "spans": np.int64, "children": np.int64}
        a = {p: np.frombuffer(row[p], whole.get(p, np.float64)) for p in PARTS[2:]}
        self.points, self.centres = a["points"].reshape(-1, dim), a["centres"].reshape(-1, dim)
        self.ends, self.ids, self.none, self.radii = a["ends"], a["ids"], a["none"], a["radii"]
        self.spans, self.children = a["spans"].reshape(-1, 2), a["children"].reshape(-1, 2)
        self.top = int(np.abs(self.points).max())

    def bounds(self, node: int, q: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Above every inner product in a node; widened by more than rounding can take."""
        centre, radius = self.centres[node], self.radii[node]
        slack = 1e-9 * (lengths * (math.sqrt(float(centre @ centre)) + radius) + 1)
        return q @ centre + lengths * radius + slack

    def leaves(self, q: np.ndarray, lengths: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf nodes, their bounds per query): -inf where a ball around the leaf cannot reach the query's floor."""
        found, columns = [], []
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, who = stack.pop()
            bound = self.bounds(node, q[who], lengths[who])
            keep = bound >= floor[who]
            who, bound = who[keep], bound[keep]
            if not len(who):
                continue
            left, right = self.children[node]
            if left >= 0:
                stack += [(left, who), (right, who)]
                continue
            column = np.full(len(q), -np.inf)
            column[who] = bound
            found.append(node)
            columns.append(column)
        return np.array(found, np.int64), np.stack(columns, axis=1) if found else np.empty((len(q), 0))

    def search(self, q: np.ndarray, best: Best, places: np.ndarray) -> None:
        """Offer every point that can be among the best of a query; `places` are the queries' positions in `best`."""
        limit = q.shape[1] * int(np.abs(q).max()) * self.top
        if limit >= 1 << 63:
            raise OverflowError("an inner product may not fit 64 bits")
        kind = np.float64 if limit < 1 << 53 else np.int64  # both exact; doubles are multiplied faster
        own, x, wide = q.astype(kind), self.points.astype(kind), q.astype(np.float64)
        lengths = np.sqrt((wide * wide).sum(axis=1))
        leaves, bound = self.leaves(wide, lengths, best.floor[places].astype(np.float64))
        order = np.argsort(-bound, axis=1, kind="stable")
        first, width = 0, 1
        while first < len(leaves):
            columns = order[:, first : first + width]
            reach = np.take_along_axis(bound, columns, axis=1)
            who, j = np.nonzero((reach > -np.inf) & (reach >= best.floor[places].astype(np.float64)[:, None]))
            if not len(who):
                break  # bounds fall from column to column, and floors only rise
            leaf = columns[who, j]
            by_leaf = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
            hits = []
            for group in np.split(by_leaf, cuts):
                rows = who[group]
                lo, hi = self.spans[leaves[leaf[group[0]]]]
                scores = (own[rows] @ x[lo:hi].T).astype(np.int64)
                i, p = np.nonzero(scores >= best.floor[places[rows]][:, None])
                hits.append((places[rows[i]], scores[i, p], p + lo))
            self.offer(best, *(np.concatenate(part) for part in zip(*hits, strict=True)))
            first, width = first + width, 2 * width

    def offer(self, best: Best, query: np.ndarray, score: np.ndarray, point: np.ndarray) -> None:
        """Points by their first ids: of one point, no more than k ids can be among the k best."""
        start = np.where(point > 0, self.ends[point - 1], 0)
        n = np.minimum(self.ends[point] - start, best.k)
        row = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        best.offer(np.repeat(query, n), np.repeat(score, n), self.ids[row], self.none[row])


def _searched(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, floor, groups = block.value
        best = Best(len(names), k, floor)
        for batch in batches:
            for at in range(batch.num_rows):  # one tree at a time
                row = batch.slice(at, 1).to_pylist()[0]
                if row["dim"] in groups:
                    places, q = groups[row["dim"]]
                    Tree(row).search(q, best, places)
        yield best.rows(names)

    return run


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, vectors = integers(batch.column("embedding"))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id").take(pa.array(good)),
                pa.array([len(v) for v in vectors], pa.int32()),
                pa.array([int(v @ v) if int(np.abs(v).max()) ** 2 * len(v) < 1 << 63 else None for v in vectors], pa.int64()),
                pa.array([v.tobytes() for v in vectors], pa.binary()),
            ],
            ["query_id", "dim", "own", "point"],
        )


def top_inner_products(df: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `df` with the highest inner product of each row of `queries`.

    `queries` are rows of `df`. Components count as floor(256 * x); ties go to the smaller id, null ids last. Only a
    query's own row is no candidate of its own: other rows with its vector or its id are. Vectors that are null or empty
    or hold null or non-finite components take no part, and only vectors of one length are compared. A query with fewer
    candidates gets them all, one without any (or an empty table) no row. A query row that repeats gets its rows each
    time. A score that might not fit 64 bits raises OverflowError. Other columns are not read.
    """
    spark = df.sparkSession

    def columns(of: DataFrame) -> DataFrame:
        return of.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("embedding")).where("embedding is not null")

    shards = stored(columns(df).mapInArrow(_shards, TREE).withColumn("wave", wave_of("shard")), "shards")
    asked = columns(queries).mapInArrow(_points, "query_id long, dim int, own long, point binary")
    asked = stored(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    size = asked.agg(F.coalesce(F.sum(F.length("point")), F.lit(0))).first()[0]
    n_blocks = -(-size // BLOCK_BYTES)
    results = scratch(spark, "nearest")
    asked.select("query", F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("id")).limit(0).write.parquet(results)
    for b in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b)
        rows = mine.select("query", "dim", "point").toArrow()
        if rows.num_rows:
            _search_block(rows, shards, k + 1).write.mode("append").parquet(results)
    drop_stored(shards)
    # A query's own row has its own score and id; of equal ones it does not matter which goes.
    found = spark.read.schema(FOUND).parquet(results)
    both = found.join(asked.select("query", "query_id", "own"), "query")
    same = (F.col("score") == F.col("own")) & F.col("id").eqNullSafe(F.col("query_id"))
    ranked = k_best(both, k + 1).withColumn("mine", F.when(same, F.col("rank")))
    # with more than k + 1 equal copies of its own row none but these are listed, and the last goes as well as any
    ranked = ranked.groupBy("query", "query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("rows"), F.min("mine").alias("mine")
    )
    others = F.slice(F.filter("rows", lambda r: F.col("mine").isNull() | (r["rank"] != F.col("mine"))), 1, k)
    return ranked.select("query_id", F.posexplode(others).alias("at", "r")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("r.id").alias("vec_id"), F.col("r.score").alias("score")
    )


def _search_block(rows: pa.Table, shards: DataFrame, k: int) -> DataFrame:
    """`FOUND` of one block of queries; `k` counts a query's own row."""
    context = shards.sparkSession.sparkContext
    names, dims = rows.column("query").to_numpy(), rows.column("dim").to_numpy()
    points = rows.column("point").to_pylist()
    groups = {}
    for dim in np.unique(dims).tolist():
        places = np.flatnonzero(dims == dim)
        groups[dim] = (places, np.frombuffer(b"".join(points[p] for p in places), np.int64).reshape(-1, dim))
    floor, so_far = np.full(len(names), LEAST, np.int64), None
    for wave in range(3):
        block = context.broadcast((names, floor, groups))
        found = shards.where(F.col("wave") == wave).mapInArrow(_searched(block, k), FOUND)
        if so_far is not None:
            found = found.union(so_far.select("query", "score", "id"))
        last, so_far = so_far, stored(k_best(found, k), "best")
        block.destroy()
        if last is not None:
            drop_stored(last)
        if wave < 2:
            floor = floors(so_far, k, names, LEAST)
    return so_far.select("query", "score", "id")
