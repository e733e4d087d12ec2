"""Token ids in files, as canonical length-limited Huffman codes.

Code lengths come from the counts of all ids (package-merge, at most `LIMIT` bits), and the codes from the lengths alone.
A file holds a head (magic, vocabulary size, the code lengths) and blocks. A block holds whole documents and can be read
by itself: its document ids and sizes, the bit offset of every `STEP`-th id, and the code bits. The decoder looks up the
next `LIMIT` bits in one table and works on all checkpoints of a block side by side.

Files hold documents in ascending id order. One Spark task writes or reads one file and holds one block at a time; only
counts per id (bounded by the vocabulary) and totals per file meet on the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm._shared import scratch, stored, text_slices
from skarn.llm.word_tokens import encoder

LIMIT = 16  # bits of the longest code
STEP = 256  # ids between checkpoints
BLOCK = 1 << 20  # ids after which a block ends with its document
FILE = 1 << 26  # ids of a file, about, where there are more files than shuffle partitions

MAGIC = b"SKHUF1\0\0"
HEAD = struct.Struct("<8sI")
BLOCK_HEAD = struct.Struct("<IQQ")  # documents, ids, bytes of code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code length of each id under `limit` bits by package-merge; 0 for ids that do not occur.

    Ties go to the smaller id, so equal counts give equal lengths on any machine. One id alone gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    n = len(used)
    # each level merges the items with the packages (pairs) of the level below; `is_item` in sorted order
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < n)
        merged = merged[order]
        pairs = len(merged) // 2
        packages = merged[: 2 * pairs].reshape(pairs, 2).sum(axis=1)
    # walk back: the first `take` entries of a level are chosen; its packages choose twice as many below
    take = 2 * n - 2
    for is_item in reversed(levels):
        items = int(is_item[:take].sum())
        lengths[used[:items]] += 1
        take = 2 * (take - items)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the successor of the one before."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sizes = lengths[order].astype(np.int64)
    # a code of length s takes 2^(top - s) of the values of the longest length
    top = int(sizes[-1]) if len(sizes) else 0
    spans = 1 << (top - sizes)
    codes[order] = ((np.cumsum(spans) - spans) >> (top - sizes)).astype(np.uint32)
    return codes


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.codes = canonical_codes(lengths)
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every value of `LIMIT` bits: the id whose code it starts with, and that code's length."""
        if self._table is None:
            ids, sizes = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.uint8)
            used = np.flatnonzero(self.lengths)
            used = used[np.argsort(self.codes[used].astype(np.int64) << (LIMIT - self.lengths[used].astype(np.int64)))]
            spans = 1 << (LIMIT - self.lengths[used].astype(np.int64))
            ids[: spans.sum()] = np.repeat(used, spans)
            sizes[: spans.sum()] = np.repeat(self.lengths[used], spans)
            self._table = ids, sizes
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(code bits, bit offset of every `STEP`-th id)."""
        if not len(ids):
            return b"", np.empty(0, np.uint64)
        sizes = self.lengths[ids].astype(np.int64)
        if not sizes.all():
            raise ValueError("an id without a code")
        ends = np.cumsum(sizes)
        starts = ends - sizes
        # a code touches at most two 32-bit words, and codes share no bit: sums of words are their unions
        value = self.codes[ids].astype(np.uint64) << (64 - (starts & 31) - sizes).astype(np.uint64)
        word = starts >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
        words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::STEP].astype(np.uint64)

    def decode(self, code: bytes, n: int, checkpoints: np.ndarray) -> np.ndarray:
        """`n` ids, all checkpoints side by side."""
        ids, sizes = self.table
        raw = np.frombuffer(code + b"\0\0\0", np.uint8).astype(np.uint32)
        # the 24 bits from each byte on
        wide = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        lanes = len(checkpoints)
        out = np.empty((STEP, lanes), np.uint32)
        at = checkpoints.astype(np.int64)
        last = len(wide) - 1
        for k in range(STEP):
            alive = lanes if k < n - (lanes - 1) * STEP or not lanes else lanes - 1
            here = at[:alive]
            bits = (wide[np.minimum(here >> 3, last)] >> (24 - LIMIT - (here & 7)).astype(np.uint32)) & ((1 << LIMIT) - 1)
            out[k, :alive] = ids[bits]
            at[:alive] = here + sizes[bits]
        return out.T.reshape(-1)[:n]


def file_head(lengths: bytes) -> bytes:
    return HEAD.pack(MAGIC, len(lengths)) + lengths


def write_block(codec: Codec, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    code, checkpoints = codec.encode(ids)
    return b"".join(
        (
            BLOCK_HEAD.pack(len(docs), len(ids), len(code)),
            docs.astype("<i8").tobytes(),
            sizes.astype("<u8").tobytes(),
            checkpoints.astype("<u8").tobytes(),
            code,
        )
    )


def read_file(file) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, their sizes, ids) of each block of an open file."""
    magic, vocabulary = HEAD.unpack(file.read(HEAD.size))
    if magic != MAGIC:
        raise ValueError("not a file of Huffman-coded ids")
    codec = Codec(np.frombuffer(file.read(vocabulary), np.uint8))
    while head := file.read(BLOCK_HEAD.size):
        n_docs, n_ids, n_bytes = BLOCK_HEAD.unpack(head)
        docs = np.frombuffer(file.read(8 * n_docs), "<i8")
        sizes = np.frombuffer(file.read(8 * n_docs), "<u8")
        checkpoints = np.frombuffer(file.read(8 * -(-n_ids // STEP)), "<u8")
        yield docs, sizes, codec.decode(file.read(n_bytes), n_ids, checkpoints)


def tokenized(df: DataFrame, tokenizer: str, end_id: int | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): ids of whole texts as little-endian integers of the vocabulary's width; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for rows in text_slices(batch, text_column):
                ids, ends = encode(rows.column(text_column), end_id)
                bounds = np.concatenate([[0], ends]) * ids.itemsize
                offsets = pa.py_buffer(bounds.astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([rows.column(id_column).cast(pa.int64()), packed], ["doc_id", "ids"])

    return df.select(id_column, text_column).mapInArrow(run, "doc_id long, ids binary")


def write_ids(tokens: DataFrame, path: str, vocabulary: int, width: int, files: int | None = None) -> DataFrame:
    """Write (doc_id, ids) in ascending doc_id order under `path`; returns the stored list of files.

    The list has (file, name, n_docs, n_ids), files in document order. Documents that share a doc_id stand side by side in
    any order, a null id comes first and is written as the smallest integer. A table without rows gives no file.
    """
    spark = tokens.sparkSession
    dtype = f"<u{width}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("ids"), dtype), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    counted = tokens.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for row in counted.collect():  # one row per id of the vocabulary at most
        counts[row["token"]] = row["n"]
    lengths = code_lengths(counts).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"ids-{context.partitionId():06d}-{context.taskAttemptId()}.huf"
        codec, out = Codec(np.frombuffer(lengths, np.uint8)), None
        docs, parts, held, n_docs, n_ids = [], [], 0, 0, 0

        def flush() -> None:
            nonlocal out, held, n_docs, n_ids
            if out is None:
                out = _open(path, name, "wb")
                out.write(file_head(lengths))
            sizes = np.array([len(p) for p in parts], np.uint64)
            out.write(write_block(codec, np.array(docs, np.int64), sizes, np.concatenate(parts)))
            n_docs, n_ids, held = n_docs + len(docs), n_ids + held, 0
            docs.clear()
            parts.clear()

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                docs.append(-(1 << 63) if doc is None else doc)
                parts.append(np.frombuffer(ids.as_buffer(), dtype).copy())
                held += len(parts[-1])
                if held >= BLOCK:
                    flush()
        if docs:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"file": pa.array([context.partitionId()], pa.int64()), "name": [name], "n_docs": [n_docs], "n_ids": [n_ids]}
            )

    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // FILE)
    ordered = tokens.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(write, "file long, name string, n_docs long, n_ids long"), "huffman-files")


def read_ids(files: DataFrame, path: str) -> DataFrame:
    """Read the listed files back: (doc_id, start, n_tokens, ids), `start` counting the ids of all documents before.

    `ids` are little-endian unsigned 32-bit integers.
    """
    base, listed = 0, []
    for row in files.orderBy("file").collect():  # one row per file
        listed.append((row["name"], base))
        base += row["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(batch.column(c).to_pylist() for c in ("name", "base")), strict=True):
                with _open(path, name, "rb") as file:
                    for docs, sizes, ids in read_file(file):
                        ends = np.cumsum(sizes.astype(np.int64))
                        offsets = pa.py_buffer((np.concatenate([[0], ends]) * 4).astype(np.int32))
                        packed = pa.Array.from_buffers(
                            pa.binary(), len(docs), [None, offsets, pa.py_buffer(ids.astype("<u4"))]
                        )
                        nulls = docs == -(1 << 63)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(docs, pa.int64(), mask=nulls),
                                pa.array(start + ends - sizes.astype(np.int64), pa.int64()),
                                pa.array(sizes.astype(np.int64), pa.int64()),
                                packed,
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        start += int(ends[-1])

    spark = files.sparkSession
    each = spark.createDataFrame(listed, "name string, base long").repartition(max(1, len(listed)))
    return each.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _flat(column: pa.Array, dtype: str) -> np.ndarray:
    """All integers of a column of packed integers, one after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    values = column.buffers()[2]
    if values is None:
        return np.empty(0, dtype)
    return np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]].view(dtype)


def _open(path: str, name: str, mode: str):
    """A file of the shared folder, local or in any store that Arrow's file systems reach."""
    from pyarrow.fs import FileSystem

    system, place = FileSystem.from_uri(path)
    if mode == "wb":
        system.create_dir(place, recursive=True)
        return system.open_output_stream(f"{place}/{name}")
    return system.open_input_stream(f"{place}/{name}")


def coded_ids(df: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Tokenize whole texts, write them as Huffman-coded files in document order, and read the files back."""
    own = encoder(tokenizer)
    tokens = stored(tokenized(df, tokenizer, end_id), "ids")
    path = scratch(df.sparkSession, "huffman")
    files = write_ids(tokens, path, own.vocabulary, own.dtype.itemsize)
    return read_ids(files, path)
