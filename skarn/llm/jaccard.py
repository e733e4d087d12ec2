"""Exact Jaccard join of word-shingle sets as a metric-space join.

1 - Jaccard similarity is a metric, and the join looks for pairs within a radius r of each other.

Level 0 deals sets to regions. A set enters one region for each of its rarest shingles, as many as two sets within r must
share at least one of (|x| - ceil(t |x|) + 1). Shingles of wide-spread passages come last: a count sketch over all texts
shows them, by how far their cells stand above an ordinary one. All others are ordered by how often their words occur, for
five frequent words meet by chance, the more so the more texts there are, and rare ones do not. Both measures keep their
meaning however large the input is. Equal sets are one point with one name.

Level 1 takes the most central point of each region as its hub and holds all others against it. Most of these pairs only
quote the same passage; sizes, the number of shared keys and parities of the sets show that (`_possible`, `_near`), and texts
move for the rest alone. Points to which sizes and shared keys allow no partner in their region but the hub leave it
(`with_partners`). Regions of one hub go on as one, without it. Points that link with the same hub form a group:
regions inside one group are settled, and of the others only points outside their settled group stay open.

Regions that are left are joined pair by pair, in tiles. One that is too large for that goes through further levels: some of
its points are pivots (the most central one and some drawn by
hash), all others get their exact distance to them, and distances of at most r are links. Regions that share a pivot go on
as one. Each point belongs to the Voronoi cell of its nearest pivot. By the triangle
inequality a partner of a point in a cell lies no more than 2r further from that cell's pivot than from its own, so the
boundary points inside this window are replicated into the cell, and points whose distance from the pivot differs by more
than r from that of every open point of the cell are left out. A point is open in its cell unless it is linked to the
pivot and no other pivot's cell could hold an unlinked partner, nor its own an unlinked one that was closed before. Cells are
the regions of the next level. Pivots are compared with all points of their region and leave it, so the recursion
ends. Only distances of candidate pairs are computed, each once a level, and copies of a text add no pair. Settled regions
end between these levels as well.

All steps are grouped aggregates and equi-joins over (region, point); a hot region is spread by adaptive execution, and
nothing per document reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm._shared import drop_stored, release, stored, text_slices
from skarn.llm.components import connected, forest
from skarn.llm.shingles import apart, fingerprint, parity, sets_of_words, shingle_sets, word_hashes

PARTS = 5  # a similarity of at least (PARTS - 1) / PARTS links: 0.8
SIZE = 5  # words of a shingle
RADIUS = 1 / PARTS
LEAF = 1 << 20  # comparisons up to which a region is joined pair by pair
TILE = (64, 128)  # open points and points that meet in one task at a time
SIDE = 1 << 11  # points of a region, about, whose sizes and shared keys meet those of as many in one group
NEAREST = 16  # points next in size that are tried first
PIVOTS = 32  # pivots of a region, about, at most
SHARE = 256  # open points for each pivot of a region, about
CELLS = 22  # bits of a shingle that choose a cell of the count sketch
WORDS = 20  # bits of a word that choose a cell of the words' counts
BLOCKS = 64  # pieces of the sketch, each of as many cells as the words' counts are cut into
FILTER = 1 << 28  # bits of the membership filter of shared keys
WANTED = 1 << 26  # bits of the other ones
BUCKETS = 1 << 10  # pieces in which keys meet, each a stretch of the filter
HELD = 1 << 22  # keys that a task collects before it sends them
SLACK = 1e-9


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    return text_slices(batch, column, 4 << 20)


def _longs(sets: list[np.ndarray]) -> pa.Array:
    """Lists of hashes as lists of signed longs."""
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _planes(values: np.ndarray) -> bytes:
    """Numbers with their lowest bytes first, then the next ones: small numbers leave little to store."""
    return zlib.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def _from_planes(packed: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype)[:, 0]


def _rows(blocks, packed: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int32()), "packed": pa.array(packed, pa.binary())})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        yield from zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True)


def _gathered(blocks: DataFrame, cells: int) -> np.ndarray:
    """The whole table of `cells` bytes: a fixed size, whatever the input."""
    out = np.zeros(cells, np.uint8)
    for row in blocks.collect():
        own = np.frombuffer(zlib.decompress(row["packed"]), np.uint8)
        out[row["block"] * len(own) : (row["block"] + 1) * len(own)] = own
    return out


def rarity(docs: DataFrame, text: str) -> np.ndarray:
    """What orders shingles: for cells of them, half octaves above the middle cell; for cells of words, quarter octaves of their number.

    Counts over all texts. An ordinary cell, full of shingles of few texts each, is 0.
    """
    piece = 1 << CELLS >> BLOCKS.bit_length() - 1
    cells = (1 << CELLS) + (1 << WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for batch in batches:
            for rows in _slices(batch, text):
                words, bounds = word_hashes(rows.column(text))
                own = np.concatenate([*(s for s, _ in sets_of_words(words, bounds, SIZE)), np.empty(0, np.uint64)])
                np.add.at(total, (own >> np.uint64(64 - CELLS)).astype(np.int64), np.uint32(1))
                np.add.at(total, (1 << CELLS) + (words >> np.uint64(64 - WORDS)).astype(np.int64), np.uint32(1))
        yield _rows(range(cells // piece), [_planes(p) for p in np.split(total, cells // piece)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # the blocks dealt to a task, each of fixed size
        for block, packed in _pieces(batches):
            total[block] = total.get(block, np.uint64(0)) + _from_planes(packed, "<u4")
        for block, own in total.items():
            steps = np.minimum(255, 8 * np.log2(own.astype(np.float64) + 1)).astype(np.uint8)
            yield _rows([block], [zlib.compress(steps.tobytes(), 1)])

    parts = docs.select(text).mapInArrow(run, "block int, packed binary").repartition("block")
    steps = _gathered(parts.mapInArrow(summed, "block int, packed binary"), cells)
    shingles, words = steps[: 1 << CELLS], steps[1 << CELLS :]
    middle = np.uint8(np.median(shingles))
    return np.concatenate([(np.maximum(shingles, middle) - middle) // 4, words // 2])


def _filter_of(values: DataFrame) -> np.ndarray:
    """Bits set at the longs of a one-column table: holds all of them and, as it fills up, some others."""
    size = WANTED // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit(batch.column(0).to_numpy(), WANTED)).astype("<u4")
            cuts = np.searchsorted(at, np.arange(BLOCKS + 1) * size)
            there = np.flatnonzero(np.diff(cuts))
            yield _rows(there, [at[cuts[k] : cuts[k + 1]].tobytes() for k in there])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for block, packed in _pieces(batches):
            own = total.setdefault(block, np.zeros(size, bool))
            own[np.frombuffer(packed, "<u4") - block * size] = True
        for block, own in total.items():
            yield _rows([block], [zlib.compress(np.packbits(own).tobytes(), 1)])

    parts = values.mapInArrow(run, "block int, packed binary").repartition("block")
    return _gathered(parts.mapInArrow(united, "block int, packed binary"), WANTED // 8)


def _spread(values: np.ndarray) -> np.ndarray:
    return values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _bit(values: np.ndarray, size: int) -> np.ndarray:
    return (_spread(values) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = _bit(values, 8 * len(bits))
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _rarest(own: np.ndarray, words: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set in one order for all sets, by `rarity` and hash: two linked sets have one in common."""
    n = len(own)
    # the smaller of two linked sets keeps at least 4/5 of the larger in common
    take = n - (n * (PARTS - 1) + PARTS - 1) // PARTS + 1 if n else 0
    above = code[(own >> np.uint64(64 - CELLS)).astype(np.int64)].astype(np.uint16)
    return own[np.argsort((above << np.uint16(10)) + words, kind="stable")[:take]]


def _sent(keys: list[np.ndarray]) -> pa.RecordBatch:
    """Keys cut to 40 bits, sorted into buckets by the first 10, as differences: less than three bytes a key."""
    low = np.sort(_spread(np.concatenate(keys))) >> np.uint64(24)
    cuts = np.searchsorted(low, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(30))
    rest = (low & np.uint64((1 << 30) - 1)).astype("<u4")
    there = np.flatnonzero(np.diff(cuts))
    return _rows(there, [_planes(np.diff(rest[cuts[k] : cuts[k + 1]], prepend=np.uint32(0))) for k in there])


def _twice(bucket: int, sent: list[bytes]) -> pa.RecordBatch:
    """The stretch of the filter with the keys that came more than once to a bucket."""
    keys = np.sort(np.concatenate([np.cumsum(_from_planes(p, "<u4"), dtype=np.uint32) for p in sent]))
    bits = np.zeros(FILTER // BUCKETS, bool)
    # 28 bits of a key choose its bit, 10 of them its bucket
    bits[keys[1:][keys[1:] == keys[:-1]] >> np.uint32(41 - FILTER.bit_length())] = True
    return _rows([bucket], [zlib.compress(np.packbits(bits).tobytes(), 1)])


def shared_keys(sets: DataFrame) -> np.ndarray:
    """A filter that holds every key of two rows of `sets`, and few others.

    Only shortened keys move; one that two sets share comes twice to its bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0
        for batch in batches:
            keys.append(batch.column("keys").flatten().to_numpy().copy())
            held += len(keys[-1])
            if held > HELD:
                yield _sent(keys)
                keys, held = [], 0
        if held:
            yield _sent(keys)
        release()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sent = 0, []
        for bucket, packed in _pieces(batches):
            if sent and bucket != at:
                yield _twice(at, sent)
                sent = []
            at = bucket
            sent.append(packed)
        if sent:
            yield _twice(at, sent)

    parts = sets.select("keys").mapInArrow(run, "block int, packed binary").repartition("block").sortWithinPartitions("block")
    return _gathered(parts.mapInArrow(met, "block int, packed binary"), FILTER // 8)


def signatures(docs: DataFrame, id_column: str, text: str, codes) -> DataFrame:
    """(doc_id, n, point, keys) of every row: set size, name of the set (null if empty), its rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, frequent = codes.value[: 1 << CELLS], codes.value[1 << CELLS :]
        for batch in batches:
            for rows in _slices(batch, text):
                words, bounds = word_hashes(rows.column(text))
                weights = frequent[(words >> np.uint64(64 - WORDS)).astype(np.int64)]
                sets = [*sets_of_words(words, bounds, SIZE, weights)]
                sizes = np.array([len(s) for s, _ in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(id_column).cast(pa.int64()),
                        pa.array(sizes),
                        pa.array([fingerprint(s) for s, _ in sets], pa.int64(), mask=sizes == 0),
                        _longs([_rarest(s, w, above) for s, w in sets]),
                    ],
                    ["doc_id", "n", "point", "keys"],
                )
        release()

    return docs.select(id_column, text).mapInArrow(run, "doc_id long, n long, point long, keys array<long>")


def distinct_sets(spark: SparkSession, points: DataFrame) -> DataFrame:
    """(doc_id, n, point, keys): any one row of each set that has a row with an id, with those of its keys that may be shared.

    Only rows that may have a copy, by a filter of fixed size, move.
    """
    named = points.where("point is not null and doc_id is not null")
    copied = stored(named.groupBy("point").agg(F.count("*").alias("c")).where("c > 1").select("point"), "copied")
    bits = spark.sparkContext.broadcast(_filter_of(copied))
    single = _sieved(named, "point", bits, inverse=True).union(_sieved(named, "point", bits).dropDuplicates(["point"]))
    shared = spark.sparkContext.broadcast(shared_keys(single))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            flat = keys.flatten().to_numpy()
            may = _has(shared.value, flat)
            ends = np.concatenate(([0], np.cumsum(may)))[np.cumsum(np.concatenate(([0], pc.list_value_length(keys).to_numpy())))]
            left = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[may]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], left], ["doc_id", "n", "point", "keys"]).filter(pa.array(np.diff(ends) > 0))
        release()

    sets = stored(single.mapInArrow(run, points.schema), "sets")
    bits.destroy()
    shared.destroy()
    drop_stored(copied)
    return sets


def first_regions(spark: SparkSession, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Level 0 over `distinct_sets`: (point, doc_id) of each set, and (region, point, n, c, degree).

    Only regions of two points or more, and of regions with equal points one: c points, each with its set's size and the
    number of its keys that other sets have. Points whose rows all lack an id link with nothing and are left out.
    """
    alike = (
        sets.select("point", F.explode("keys").alias("region"))
        .groupBy("region")
        .agg(F.count("*").alias("c"), F.expr("bit_xor(xxhash64(point))").alias("x"), F.expr("bit_xor(xxhash64(point, 1))").alias("y"))
        .where("c > 1")
    )
    one = stored(alike.groupBy("c", "x", "y").agg(F.min("region").alias("region"), F.count("*").alias("w")).select("region", "c", "w"), "regions")
    bits = spark.sparkContext.broadcast(_filter_of(one.select("region")))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            flat = keys.flatten().to_numpy()
            there = _has(bits.value, flat)
            at = np.repeat(np.arange(batch.num_rows), pc.list_value_length(keys).to_numpy())[there]
            own = batch.select(["point", "n"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(flat[there]), *own.columns], ["region", "point", "n"])

    members = stored(sets.select("point", "n", "keys").mapInArrow(kept, "region long, point long, n long").join(one, "region"), "members")
    bits.destroy()
    # in how many regions a point is: the original of many edited copies shares more shingles with them than they do
    degree = members.groupBy("point").agg(F.sum("w").alias("degree"))
    return sets.select("point", "doc_id"), stored(members.join(degree, "point").select("region", "point", "n", "c", "degree"), "members")


def _sieved(table: DataFrame, column: str, bits, inverse: bool = False) -> DataFrame:
    """Rows of a table whose value is in a broadcast filter, or those whose value is not, the ones without a value included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column)
            may = _has(bits.value, pc.fill_null(values.cast(pa.int64()), 0).to_numpy())
            may &= pc.is_valid(values).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~may if inverse else may))

    return table.mapInArrow(run, table.schema)


def _kept(table: DataFrame, column: str, wanted: DataFrame, inverse: bool = False) -> DataFrame:
    """Rows of a table that may have a value of the one-column table `wanted` of longs: all that have, and few others.

    `inverse`: the rows that surely have none of them, those without a value included.
    """
    bits = table.sparkSession.sparkContext.broadcast(_filter_of(wanted))
    out = _sieved(table, column, bits, inverse)
    out.held = bits  # to be destroyed when the rows have been used
    return out


def point_texts(docs: DataFrame, id_column: str, text: str, wanted: DataFrame) -> DataFrame:
    """(point, n, bits, text) of each wanted (point, doc_id): the text of one document of each point, its set's size and parities.

    A filter of fixed size on both columns picks the documents where they lie. It may let others through; a text is then
    there under its own point as well, which no pair asks for, or twice.
    """
    context = docs.sparkSession.sparkContext
    ids, names = (context.broadcast(_filter_of(wanted.select(c))) for c in ("doc_id", "point"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            batch = batch.filter(pa.array(_has(ids.value, batch.column(0).cast(pa.int64()).to_numpy())))
            for rows in _slices(batch, text):
                sets = shingle_sets(rows.column(text), SIZE)
                own = np.array([fingerprint(s) for s in sets], np.int64)
                there = np.flatnonzero(_has(names.value, own))
                sizes, bits = [len(sets[k]) for k in there], [parity(sets[k]) for k in there]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[there]), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), rows.column(text).take(pa.array(there))],
                    ["point", "n", "bits", "text"],
                )
        release()

    out = stored(docs.select(id_column, text).mapInArrow(run, "point long, n long, bits binary, text string"), "texts")
    ids.destroy()
    names.destroy()
    return out


def distances(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, d, linked) of distinct pairs a < b of points, from the whole sets of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, "ta"):
                for part in _slices(rows, "tb"):
                    sets = []
                    for name, text in (("a", "ta"), ("b", "tb")):
                        points, first, where = np.unique(part.column(name).to_numpy(), return_index=True, return_inverse=True)
                        own = shingle_sets(part.column(text).take(pa.array(first)), SIZE)
                        sets.append([own[k] for k in where])
                    common = np.array([_common(x, y) for x, y in zip(*sets, strict=True)], np.int64)
                    union = np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)], np.int64) - common
                    linked = PARTS * common >= (PARTS - 1) * union
                    yield pa.RecordBatch.from_arrays(
                        [part.column("a"), part.column("b"), pa.array(1 - common / np.maximum(union, 1)), pa.array(linked)],
                        ["a", "b", "d", "linked"],
                    )
        release()

    pairs = stored(pairs, "pairs")
    needed = _kept(texts.select("point", "text"), "point", pairs.select("a").union(pairs.select("b")))
    left = needed.select(F.col("point").alias("a"), F.col("text").alias("ta"))
    right = needed.select(F.col("point").alias("b"), F.col("text").alias("tb"))
    found = pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, d double, linked boolean")
    out = stored(found.dropDuplicates(["a", "b"]), "distances")
    needed.held.destroy()
    drop_stored(pairs)
    return out


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets may link by their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer(b, np.uint64) for b in batch.column(c).to_pylist()] for c in ("ba", "bb"))
            differ = np.array([int(apart(x, [y])[0]) for x, y in zip(one, two, strict=True)], np.int64)
            may = (2 * PARTS - 1) * differ <= batch.column("n").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(may))

    shapes = texts.select("point", "n", "bits").dropDuplicates(["point"])
    left = shapes.select(F.col("point").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = shapes.select(F.col("point").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "ba", "bb")
    return both.mapInArrow(run, "a long, b long")


def _possible(n: str, degree: str, other_n: str, other_degree: str):
    """Whether two sets may link by their sizes and by how many of their keys other sets share.

    All they have in common up to the end of the keys that end first is among the keys of both; after it that set has no
    more than ceil(t n) - 1 shingles.
    """
    both, larger = F.col(n) + F.col(other_n), F.greatest(n, other_n)
    most = F.least(degree, other_degree) + F.ceil(larger * (PARTS - 1) / PARTS) - 1
    sized = (2 * PARTS - 1) * F.abs(F.col(n) - F.col(other_n)) <= both
    return sized & ((2 * PARTS - 1) * most >= (PARTS - 1) * both)


def to_hubs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The most central point of each region and each other one: (hub, hub_degree, point, degree, possible), each pair once,
    and (region, hub, point, n, degree, c) of regions with more than one other point."""
    hubs = members.groupBy("region").agg(F.max(F.struct("degree", "point", "n")).alias("hub"))
    paired = stored(members.join(hubs, "region").where("point <> hub.point"), "to-hubs")
    pairs = (
        paired.select(F.col("hub.point").alias("hub"), F.col("hub.degree").alias("hub_degree"), F.col("hub.n").alias("hub_n"), "point", "degree", "n")
        .distinct()
        .withColumn("possible", _possible("n", "degree", "hub_n", "hub_degree"))
        .drop("hub_n", "n")
    )
    # a region of two is settled by its pair
    return pairs, paired.where("c > 2").select("region", F.col("hub.point").alias("hub"), "point", "n", "degree", "c")


def _may_link(n: np.ndarray, degree: np.ndarray, other_n: np.ndarray, other_degree: np.ndarray) -> np.ndarray:
    """`_possible` of arrays."""
    both, larger = n + other_n, np.maximum(n, other_n)
    most = np.minimum(degree, other_degree) + (larger * (PARTS - 1) + PARTS - 1) // PARTS - 1
    return ((2 * PARTS - 1) * abs(n - other_n) <= both) & ((2 * PARTS - 1) * most >= (PARTS - 1) * both)


def _partnered(group: np.ndarray, side: np.ndarray, point: np.ndarray, n: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """Whether each row may link with another one of its group, by `_may_link`. Rows of side 0 meet all, those of 1 and 2 one another."""
    order = np.lexsort((n, group))
    group, side, point, n, degree = (x[order] for x in (group, side, point, n, degree))

    def meet(x, y) -> np.ndarray:
        return ((side[x] == 0) | (side[x] != side[y])) & (point[x] != point[y]) & _may_link(n[x], degree[x], n[y], degree[y])

    found, rows = np.zeros(len(n), bool), np.arange(len(n))
    for k in range(1, min(NEAREST, len(n) - 1) + 1):
        at = np.flatnonzero(group[k:] == group[:-k])
        at = at[meet(rows[at], rows[at + k])]
        found[at] = found[at + k] = True
    starts = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(n)], strict=False):  # no row, no start
        if b - a > NEAREST + 1 and not found[a:b].all():
            alone = a + np.flatnonzero(~found[a:b])
            for some in np.array_split(alone, 1 + len(alone) * (b - a) // LEAF):
                found[some] = meet(some[:, None], rows[None, a:b]).any(axis=1)
    out = np.empty(len(n), bool)
    out[order] = found
    return out


def with_partners(paired: DataFrame) -> DataFrame:
    """(hub, point, degree), each once: points that may link with another one of their region by sizes and shared keys.

    A large region is a grid of groups, dealt by hash; in a group every point of one side meets every one of the other.
    """
    sides = F.ceil(F.col("c") / SIDE).cast("int")
    every, drawn = F.explode(F.sequence(F.lit(0), sides - 1)), F.pmod(F.xxhash64("point"), sides).cast("int")
    columns = ["region", "hub", "point", "n", "degree"]
    large = paired.where(sides > 1)
    dealt = (
        paired.where(sides == 1)
        .select(*columns, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
        .union(large.select(*columns, drawn.alias("i"), every.alias("j"), F.lit(1).alias("side")))
        .union(large.select(*columns, every.alias("i"), drawn.alias("j"), F.lit(2).alias("side")))
    )

    def of(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        keys = [rows.column(c).to_numpy() for c in ("region", "i", "j")]
        return np.cumsum(np.any([np.diff(k, prepend=k[:1]) != 0 for k in keys], axis=0)), [rows.column(c).to_numpy() for c in ("side", "point", "n", "degree")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            group, values = of(rows)
            done = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last group may go on in the next batch
            held = rows.slice(done)
            if done:
                there = _partnered(group[:done], *(v[:done] for v in values))
                yield from rows.slice(0, done).filter(pa.array(there)).select(["hub", "point", "degree"]).to_batches()
        if held is not None and held.num_rows:
            group, values = of(held)
            yield from held.filter(pa.array(_partnered(group, *values))).select(["hub", "point", "degree"]).to_batches()

    keys = ["region", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "hub long, point long, degree long").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.where(f"{x} <> {y}").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _tile(rows: pa.Table) -> pa.Table:
    """Links of one tile, open points against others, as few as connect what they connect."""
    points, first, where = np.unique(rows.column("point").to_numpy(), return_index=True, return_inverse=True)
    sets = shingle_sets(rows.column("text").combine_chunks().take(pa.array(first)), SIZE)
    side = rows.column("side").to_numpy()
    others, u, v = np.unique(where[~side]), [], []
    owner = np.repeat(np.arange(len(others)), [len(sets[k]) for k in others])
    flat = np.concatenate([sets[k] for k in others] + [np.empty(0, np.uint64)])
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    sizes = np.array([len(sets[k]) for k in others], np.int64)
    for k in np.unique(where[side]):
        low, high = np.searchsorted(flat, sets[k], "left"), np.searchsorted(flat, sets[k], "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(owner[at], minlength=len(others))
        union = len(sets[k]) + sizes - common
        linked = others[(PARTS * common >= (PARTS - 1) * union) & (others != k)]
        u.append(np.full(len(linked), points[k]))
        v.append(points[linked])
    none = np.empty(0, np.int64)
    links = pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate([*u, none])), "v": pa.array(np.concatenate([*v, none]))})
    return pa.Table.from_batches([*forest(iter([links]))])


def _meeting(key: tuple, rows: pa.Table) -> pa.Table:
    """The points of a tile that may link with one across: neither size nor parities of the two sets forbid it."""
    side, n = rows.column("side").to_numpy(), rows.column("n").to_numpy()
    points = rows.column("point").to_numpy()
    bits = [np.frombuffer(b, np.uint64) for b in rows.column("bits").to_pylist()]
    others = np.flatnonzero(~side)
    theirs = [bits[k] for k in others]
    meets = np.zeros(len(points), bool)
    for k in np.flatnonzero(side):
        # two sets link if they differ in no more than a ninth of the sum of their sizes
        may = (2 * PARTS - 1) * np.maximum(apart(bits[k], theirs), abs(n[others] - n[k])) <= n[others] + n[k]
        may &= points[others] != points[k]
        meets[k] = may.any()
        meets[others[may]] = True
    at = pa.array(np.flatnonzero(meets))
    region, i, j = (pa.array([v.as_py()] * len(at), v.type) for v in key)
    return pa.table([region, i, j, rows.column("side").take(at), rows.column("point").take(at)], ["region", "i", "j", "side", "point"])


def joined_pairwise(small: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) links of regions (region, point, open, n open, m points) whose open points meet all points.

    A region is a grid of tiles, dealt by hash, each a group of bounded size: no task holds a region, no pair is a row.
    Sizes and parities meet first, a few hundred bytes for a text of some thousands, and only points with a partner that
    these allow send their texts to the tile.
    """
    rows, columns = (F.ceil(F.col(c) / size).cast("int") for c, size in zip("nm", TILE, strict=True))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    drawn = lambda n, seed: F.pmod(F.xxhash64("point", F.lit(seed)), n).cast("int")
    opened = small.where("open").select("region", "point", drawn(rows, 1).alias("i"), every(columns).alias("j"), F.lit(True).alias("side"))
    others = small.select("region", "point", every(rows).alias("i"), drawn(columns, 2).alias("j"), F.lit(False).alias("side"))
    dealt = stored(opened.union(others), "tiles")
    # a text may be there twice under one point
    shapes = _kept(texts.select("point", "n", "bits"), "point", dealt.select("point").distinct())
    met = dealt.join(shapes.dropDuplicates(["point"]), "point").select("region", "i", "j", "side", "point", "n", "bits")
    likely = met.groupBy("region", "i", "j").applyInArrow(_meeting, "region long, i int, j int, side boolean, point long")
    likely = stored(likely, "likely")
    needed = _kept(texts.select("point", "text"), "point", likely.select("point").distinct())
    met = likely.join(needed.dropDuplicates(["point"]), "point").select("region", "i", "j", "side", "point", "text")
    links = stored(met.groupBy("region", "i", "j").applyInArrow(_tile, "u long, v long"), "links")
    shapes.held.destroy()
    needed.held.destroy()
    drop_stored(dealt, likely)
    return links


def next_level(members: DataFrame, texts: DataFrame, level: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Join the regions of one level: (links found, a point that each point links with, regions of the next level or None).

    Where all regions are small, tiles do the whole level and nothing is left.
    """
    counted = stored(
        members.groupBy("region").agg(
            F.expr("count_if(open)").alias("n"), F.count("*").alias("m"), F.expr("max(if(open, struct(degree, point), null)).point").alias("central")
        ),
        "counted",
    )
    sized = members.join(counted, "region")
    small = F.col("n") * F.col("m") <= LEAF
    share = F.least(F.col("n") / SHARE, F.lit(float(PIVOTS))) / F.col("n")
    drawn = F.pmod(F.xxhash64("point", F.lit(level)), F.lit(1 << 20)) < share * (1 << 20)
    pivots = stored(
        sized.where(F.col("open") & ~small & ((F.col("point") == F.col("central")) | drawn)).select("region", F.col("point").alias("pivot")),
        "pivots",
    )
    tiled = joined_pairwise(sized.where(small), texts)
    if pivots.isEmpty():
        drop_stored(counted, pivots, members)
        return tiled, None, None
    to_pivot = members.join(pivots, "region")
    found = distances(_ordered(to_pivot, "point", "pivot"), texts)
    links = found.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = links.union(tiled)
    rest = to_pivot.join(pivots.select("region", F.col("pivot").alias("point")), ["region", "point"], "left_anti")
    rest = rest.withColumn("a", F.least("point", "pivot")).withColumn("b", F.greatest("point", "pivot"))
    rest = stored(rest.join(found, ["a", "b"]).select("region", "point", "open", "degree", "pivot", "d", "linked"), "to-pivots")
    nearest = rest.groupBy("region", "point").agg(
        F.min(F.struct("d", "pivot")).alias("near"),
        F.expr(f"count_if(not linked and d <= {2 * RADIUS + SLACK})").alias("beyond"),
        F.expr("count_if(linked)").alias("links"),
    )
    placed = rest.join(nearest, ["region", "point"]).where(F.col("d") - F.col("near.d") <= 2 * RADIUS + SLACK)
    # what was closed before and links with no pivot here stays closed: a point that may link with it must not close
    shut = placed.where(f"not open and links = 0 and d <= {2 * RADIUS + SLACK}").groupBy("region", "pivot").agg(F.min("d").alias("shut"))
    apart = (F.col("links") == 0) | (F.col("beyond") > 0) | (F.col("shut") - F.col("d") <= RADIUS + SLACK)
    cells = (
        placed.join(shut, ["region", "pivot"], "left")
        .withColumn("open", F.col("open") & (F.col("pivot") == F.col("near.pivot")) & F.coalesce(apart, F.lit(False)))
        # regions that share a pivot go on as one
        .groupBy("pivot", "point")
        .agg(F.max("open").alias("open"), F.max("degree").alias("degree"), F.min("d").alias("d"))
    )
    cells = stored(cells, "cells")
    ranges = stored(cells.where("open").groupBy("pivot").agg(F.min("d").alias("low"), F.max("d").alias("high")), "ranges")
    after = stored(
        cells.join(ranges, "pivot")
        .where(F.col("open") | F.col("d").between(F.col("low") - RADIUS - SLACK, F.col("high") + RADIUS + SLACK))
        .select(F.col("pivot").alias("region"), "point", "open", "degree"),
        "members",
    )
    hubs = rest.where("linked").select(F.col("point").alias("u"), F.col("pivot").alias("v"))
    hubs = stored(hubs.union(tiled).groupBy("u").agg(F.min("v").alias("v")), "hubs")
    drop_stored(counted, pivots, rest, cells, ranges, members)
    return links, hubs, (None if after.isEmpty() else after)


def unsettled(members: DataFrame, hubs: DataFrame) -> DataFrame | None:
    """Regions that still hold points of several groups, each set of points once; None if none does.

    Points that link with the same hub are a group and need no comparison. In a region whose closed points all belong to
    one group, or that has none, that group (or the largest) closes: any pair of two groups keeps an open point.
    """
    placed = members.join(hubs.select(F.col("u").alias("point"), F.col("v").alias("root")), "point", "left")
    placed = placed.withColumn("root", F.coalesce("root", "point"))
    placed = stored(placed.select("region", "point", "open", "degree", "root"), "members")
    regions = (
        placed.groupBy("region")
        .agg(
            F.min("root").alias("a"),
            F.max("root").alias("b"),
            F.min(F.expr("if(open, null, root)")).alias("ca"),
            F.max(F.expr("if(open, null, root)")).alias("cb"),
            F.count("*").alias("c"),
            F.sum(F.xxhash64("point", "open").cast("decimal(38,0)")).alias("s"),
            F.expr("bit_xor(xxhash64(point, open, 1))").alias("x"),
        )
        .where("a < b")
    )
    regions = stored(regions.groupBy("c", "a", "b", "ca", "cb", "s", "x").agg(F.min("region").alias("region")), "regions")
    sizes = placed.join(regions.where("ca is null").select("region"), "region").groupBy("region", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("region").agg(F.max(F.struct("n", "root")).alias("top")).select("region", F.col("top.root").alias("largest"))
    closing = regions.join(largest, "region", "left").select(
        "region", F.expr("case when ca is null then largest when ca = cb then ca end").alias("closing")
    )
    after = placed.join(stored(closing, "regions"), "region").select(
        "region", "point", (F.col("open") & ~F.coalesce(F.col("root") == F.col("closing"), F.lit(False))).alias("open"), "degree"
    )
    after = stored(after, "members")
    drop_stored(placed, regions)
    return None if after.isEmpty() else after


def linked_points(spark: SparkSession, docs: DataFrame, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, point) of every row, and (u, v): links that connect all points that links connect."""
    codes = spark.sparkContext.broadcast(rarity(docs, text))
    signed = stored(signatures(docs, id_column, text, codes), "signatures")
    codes.destroy()
    ids, members = first_regions(spark, distinct_sets(spark, signed))
    points = stored(signed.select("doc_id", "n", "point"), "points")
    drop_stored(signed)
    pairs, paired = to_hubs(members)
    pairs, meeting = stored(pairs, "to-hubs"), stored(with_partners(paired), "meeting")
    needed = meeting.select("point").union(pairs.where("possible").select(F.explode(F.array("point", "hub")))).distinct()
    texts = point_texts(docs, id_column, text, stored(needed.join(ids, "point"), "wanted"))
    ordered = pairs.select(F.least("hub", "point").alias("a"), F.greatest("hub", "point").alias("b"), "hub", "hub_degree", "point", "possible")
    found = distances(_near(ordered.where("possible").select("a", "b").distinct(), texts), texts)
    links = found.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    groups = ordered.join(found.where("linked").select("a", "b"), ["a", "b"]).groupBy(F.col("point").alias("u"))
    hubs = stored(groups.agg(F.max(F.struct("hub_degree", "hub")).alias("top")).select("u", F.col("top.hub").alias("v")), "hubs")
    rest = meeting.select(F.col("hub").alias("region"), "point", F.lit(True).alias("open"), "degree")
    members, level = unsettled(rest, hubs), 1
    while members is not None:
        level += 1
        own, near, members = next_level(members, texts, level)
        links = links.union(own)
        if members is not None:
            hubs = stored(hubs.union(near).groupBy("u").agg(F.min("v").alias("v")), "hubs")
            before, members = members, unsettled(members, hubs)
            drop_stored(before)
    return points.select("doc_id", "n", "point"), links


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    `component_id` is the smallest doc_id that links reach. A null, empty or blank text has no shingle and links with
    nothing. Rows that repeat a text or an id link like any others and each gets its row; a row without an id gets no
    component and links with nothing by itself. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    points, links = linked_points(spark, docs, id_column, text_column)
    roots = connected(links).select(F.col("node").alias("point"), "root")
    placed = stored(
        points.join(roots, "point", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "point").alias("root")),
        "placed",
    )
    firsts = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(stored(firsts, "firsts"), "root", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group of linked documents the one with the smallest id.

    Rows with equal id and equal text leave one; rows without an id stay. Only rows that may be concerned, by a filter of
    fixed size over their ids, move at all.
    """
    groups = near_duplicates(docs, id_column, text_column).where("doc_id is not null")
    groups = stored(groups.select("doc_id", "component_id"), "groups")
    copies = stored(groups.where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    again = groups.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    concerned = stored(copies.union(again), "concerned")
    apart = _kept(docs, id_column, concerned)
    apart = apart.join(copies.select(F.col("doc_id").alias(id_column)), id_column, "left_anti").dropDuplicates([id_column, text_column])
    return _kept(docs, id_column, concerned, inverse=True).unionByName(apart.select(docs.columns))
