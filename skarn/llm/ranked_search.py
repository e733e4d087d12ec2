"""Exact ranked lexical search by two trees: items on one side, documents on the other.

One pass over the texts keeps of each document its number of terms and its counts of the items' terms. The statistics of
the score come from that table, and a term of a document then has a fixed value in the score of any item that has it. Each
task builds trees over chunks of its documents; a node of either tree holds, per term, the largest value or weight below it,
so the inner product of two nodes bounds every score between their items and documents. A pair of nodes is left as soon as
the bound lies below the weakest kth score of its items, and with it the whole batch; otherwise the larger node is opened,
the more promising half first. Leaves are scored whole. kth scores pass from chunk to chunk in a task, and between tasks by
three waves of documents: 1/64, 1/8, the rest.

All of it is integer arithmetic. Doubles carry it where every sum stays below 2^53.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm._shared import drop_stored, scratch, stored
from skarn.llm.best import FOUND, Best, floors, k_best, wave_of

ITEM_BYTES = 8 << 20  # texts of the items that one pass over the documents serves
TREE_ITEMS, TREE_TERMS = 512, 8192  # items of a tree, and terms beyond which it takes no further item
ITEM_LEAF, DOC_LEAF, CHUNK = 8, 32, 1024
SLICE = 4 << 20  # bytes of a text cut into terms at a time
BASE, SHARE = 100 - 90, 90

_CHANGE = bytes(
    (b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: bytes) -> Counter:
    """The terms of a UTF-8 text and their number: letters and digits of ASCII and everything beyond it, A-Z lowered."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and _CHANGE[text[end]] != 32:
            end += 1
        found.update(text[at:end].translate(_CHANGE).split())
        at = end
    return found


def _measured(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = vocabulary.value
        for batch in batches:
            n, at, tf = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                found = terms(text.as_py() or b"")
                own = sorted((known[t], found[t]) for t in found.keys() & known.keys())
                n.append(found.total())
                at.append([k for k, _ in own])
                tf.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))],
                ["doc_id", "n", "at", "tf"],
            )

    return run


class ItemTree:
    """Some items by the terms they have, and a binary tree over stretches of them."""

    def __init__(self, places: np.ndarray, lists: list[list[int]], weights: np.ndarray):
        self.terms = np.unique(np.concatenate([np.array(t, np.int64) for t in lists]))
        dense = np.zeros((len(lists), len(self.terms)), np.int64)
        for k, own in enumerate(lists):
            dense[k, np.searchsorted(self.terms, own)] = weights[own]
        # items that share their heaviest terms lie side by side
        top = np.argsort(-dense, axis=1, kind="stable")[:, :2]
        order = np.lexsort(top.T[::-1])
        self.places, self.dense = places[order], dense[order]
        self.low, self.high, self.left, self.right, peaks = _halved(len(lists), ITEM_LEAF, self.dense)
        safe = int(dense.sum(axis=1).max(initial=0)) * 1_000_000 < 1 << 53
        self.kind = np.float64 if safe else np.int64
        self.dense, self.peaks = self.dense.astype(self.kind), peaks.astype(self.kind)
        self.used = [np.flatnonzero(p) for p in self.peaks]


def _halved(n: int, leaf: int, values: np.ndarray) -> tuple[list[int], list[int], list[int], list[int], np.ndarray]:
    """Nodes of a tree over n rows, halved down to `leaf`: bounds, children (-1: a leaf) and the maxima of each column."""
    low, high, left, right, node = [0], [n], [], [], 0
    while node < len(low):
        lo, hi = low[node], high[node]
        if hi - lo > leaf:
            middle = (lo + hi) // 2
            left.append(len(low))
            right.append(len(low) + 1)
            low += [lo, middle]
            high += [middle, hi]
        else:
            left.append(-1)
            right.append(-1)
        node += 1
    peaks = np.zeros((len(low), values.shape[1]), values.dtype)
    for k in reversed(range(len(low))):
        peaks[k] = values[low[k] : high[k]].max(axis=0) if left[k] < 0 else np.maximum(peaks[left[k]], peaks[right[k]])
    return low, high, left, right, peaks


class DocChunk:
    """Values of documents' terms, by document."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.ids, self.none, self.doc, self.term, self.value = ids, none, doc, term, value

    def search(self, tree: ItemTree, best: Best) -> None:
        column = np.searchsorted(tree.terms, self.term)
        column[column == len(tree.terms)] = 0
        mine = tree.terms[column] == self.term
        doc, column, value = self.doc[mine], column[mine], self.value[mine]
        docs = np.unique(doc)
        if not len(docs):
            return
        dense = np.zeros((len(docs), len(tree.terms)), tree.kind)
        dense[np.searchsorted(docs, doc), column] = value
        # documents whose values count most for the same terms lie side by side
        top = (dense * tree.peaks[0]).argmax(axis=1)
        order = np.lexsort((-dense[np.arange(len(docs)), top], top))
        dense, docs = dense[order], docs[order]
        low, high, left, right, peaks = _halved(len(docs), DOC_LEAF, dense)
        stack = [(0, 0)]
        while stack:
            d, i = stack.pop()
            used = tree.used[i]
            bound = peaks[d][used] @ tree.peaks[i][used]
            items = tree.places[tree.low[i] : tree.high[i]]
            if bound < best.floor[items].min():
                continue
            if left[d] < 0 and tree.left[i] < 0:
                weights = tree.dense[tree.low[i] : tree.high[i]][:, used]
                scores = (dense[low[d] : high[d]][:, used] @ weights.T).astype(np.int64)
                a, b = np.nonzero(scores >= best.floor[items][None, :])
                rows = docs[low[d] + a]
                best.offer(items[b], scores[a, b], self.ids[rows], self.none[rows])
                continue
            open_docs = tree.left[i] < 0 or (left[d] >= 0 and high[d] - low[d] >= tree.high[i] - tree.low[i])
            pairs = [(left[d], i), (right[d], i)] if open_docs else [(d, tree.left[i]), (d, tree.right[i])]
            pairs.sort(key=lambda p: float(peaks[p[0]][tree.used[p[1]]] @ tree.peaks[p[1]][tree.used[p[1]]]))
            stack += pairs  # the more promising one is on top


def _values(n: int, total: int, docs: int, tf: np.ndarray) -> np.ndarray:
    m = BASE + SHARE * n * docs // total
    return np.array([1_000_000_000 * t // (1000 * t + 8 * m) for t in tf.tolist()], np.int64)


def _searched(shared, docs: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, floor, forest = shared.value
        best = Best(len(names), k, floor)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(start, CHUNK)
                at, tf = rows.column("at"), rows.column("tf")
                sizes = np.diff(at.offsets.to_numpy())
                term, counts = at.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy()
                ends = np.cumsum(sizes)
                n = rows.column("n").to_pylist()
                some = np.flatnonzero(sizes)
                if not len(some):
                    continue
                value = np.concatenate([_values(n[j], total, docs, counts[ends[j] - sizes[j] : ends[j]]) for j in some])
                none = np.asarray(rows.column("doc_id").is_null())
                ids = rows.column("doc_id").fill_null(0).to_numpy()
                chunk = DocChunk(ids, none, np.repeat(np.arange(rows.num_rows), sizes), term, value)
                for tree in forest:
                    chunk.search(tree, best)
        yield best.rows(names)

    return run


def _forest(lists: list[list[int]], weights: np.ndarray) -> list[ItemTree]:
    forest, places, seen = [], [], set()

    def close() -> None:
        if places:
            forest.append(ItemTree(np.array(places), [lists[p] for p in places], weights))
            places.clear()
            seen.clear()

    for place, own in enumerate(lists):
        if not own:
            continue
        if len(places) == TREE_ITEMS or (places and len(seen.union(own)) > TREE_TERMS):
            close()
        places.append(place)
        seen.update(own)
    close()
    return forest


def ranked_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 of each item.

    Terms are maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` in a whole text with A-Z lowered; null and
    empty texts have none. Equal scores go by ascending id, null ids last. Documents that repeat an id count each, and an
    item row that repeats gets its rows each time. An item without terms, or whose terms no document has, gets no row; so
    do empty tables. Other columns are not read.

    Items are served in blocks of at most `ITEM_BYTES` of text, or of one item; each block reads the documents once.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    asked = items.select(F.col(item_column).alias("item_id"), F.col("text")).where(F.length("text") > 0)
    asked = stored(asked.withColumn("query", F.monotonically_increasing_id()).withColumn("size", F.octet_length("text")), "items")
    size = asked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_blocks = -(-size // ITEM_BYTES)
    results = scratch(spark, "ranked")
    asked.select("query", F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("id")).limit(0).write.parquet(results)
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b).select("query", "text").toArrow()
        if rows.num_rows:
            _rank_block(read, rows, k, results)
    found = k_best(spark.read.schema(FOUND).parquet(results), k)
    return found.join(asked.select("query", "item_id"), "query").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"
    )


def _rank_block(read: DataFrame, rows: pa.Table, k: int, results: str) -> None:
    context = read.sparkSession.sparkContext
    names = rows.column("query").to_numpy()
    known: dict[bytes, int] = {}
    lists = [sorted(known.setdefault(t, len(known)) for t in terms(text.encode())) for text in rows.column("text").to_pylist()]
    vocabulary = context.broadcast(known)
    vectors = read.mapInArrow(_measured(vocabulary), "doc_id long, n long, at array<int>, tf array<long>")
    vectors = stored(vectors.where("n > 0").withColumn("wave", wave_of("doc_id", "n", "at", "tf")), "vectors")
    vocabulary.destroy()
    docs, total, most = vectors.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    if docs and SHARE * most * docs >= 1 << 63:
        raise OverflowError("the length of a text does not fit 64 bits when scaled")
    df = np.zeros(len(known), np.int64)
    held = vectors.select(F.explode("at").alias("term")).groupBy("term").count().toArrow()  # a row a term of the items
    df[held.column("term").to_numpy()] = held.column("count").to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    forest = _forest(lists, weights)
    floor, so_far = np.ones(len(names), np.int64), None
    for wave in range(3):
        shared = context.broadcast((names, floor, forest))
        part = vectors.where(F.col("wave") == wave).select("doc_id", "n", "at", "tf")
        found = part.mapInArrow(_searched(shared, docs, total, k), FOUND)
        if so_far is not None:
            found = found.union(so_far.select("query", "score", "id"))
        last, so_far = so_far, stored(k_best(found, k), "best")
        shared.destroy()
        if last is not None:
            drop_stored(last)
        if wave < 2:
            floor = floors(so_far, k, names, 1)
    so_far.select("query", "score", "id").write.mode("append").parquet(results)
    drop_stored(so_far, vectors)
