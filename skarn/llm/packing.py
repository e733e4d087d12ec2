"""Sequence packing as vector bin packing with the dot-product heuristic.

A sequence has three limits at once: tokens, segments, and tokens that bear loss. An item is an example or a part of
one, with a demand in each dimension. The open sequence takes the waiting item whose demand has the largest weighted dot
product with what the sequence has left (each dimension scaled by its limit and weighted by its mean demand among the
waiting items). Where examples may be cut, an item that no longer fits whole gives as much as fits, so a sequence closes
full or with a limit reached.

Each task packs the rows of its own partition from a bounded pool, so no row moves and no task waits for another.
Partition contents and order are those of the input splits: a task that runs again after a lost executor returns the same
rows. A sequence that ends short is cut at powers of two, a length that needs no padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from skarn.llm._shared import text_slices
from skarn.llm.word_tokens import encoder

POOL = 2048  # items that wait in a task at once


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


@dataclass
class Piece:
    """`length` tokens of example `item` from its token `start`, placed at `offset` of a sequence."""

    item: int
    start: int
    length: int
    loss: int
    sequence: int = -1
    offset: int = 0


class Packer:
    """Packs examples one pool at a time. `cut`: examples may be split anywhere.

    `add` takes (item, tokens, tokens that bear loss); a cut part bears the loss of its last tokens first, as answers
    follow prompts. `done` gets the pieces of each closed sequence. Without `cut`, an example over a limit cannot be
    placed: it closes alone in a sequence of its own, so that nothing is dropped and callers can see it.
    """

    def __init__(self, limits: Limits, cut: bool, done: Callable[[list[Piece]], None], pool: int = POOL):
        self.limits, self.cut, self.done, self.pool = limits, cut, done, pool
        self.most = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.waiting: list[Piece] = []
        self.sequence = 0

    def add(self, item: int, tokens: int, loss: int) -> None:
        start = 0
        while self.cut and tokens - start >= self.limits.tokens and loss <= tokens:
            part = self._head(Piece(item, start, tokens - start, loss), self.limits.tokens, self.limits.loss)
            if part.length < self.limits.tokens:  # the loss limit came first: leave it to the pool
                break
            self._close([part])
            start, loss = start + part.length, loss - part.loss
        if not self.cut and (tokens > self.limits.tokens or loss > self.limits.loss):
            self._close([Piece(item, 0, tokens, loss)])
            return
        if tokens > start:
            self.waiting.append(Piece(item, start, tokens - start, loss))
            if len(self.waiting) >= self.pool:
                self._fill(self.pool // 2)

    def finish(self) -> None:
        self._fill(0)

    @staticmethod
    def _head(piece: Piece, tokens: int, loss: int) -> Piece:
        """The longest head of a piece within both limits; its prompt tokens come before those that bear loss."""
        free = piece.length - piece.loss
        length = min(tokens, piece.length, free + loss)
        return Piece(piece.item, piece.start, length, max(0, length - free))

    def _fill(self, leave: int) -> None:
        """Close sequences until at most `leave` items wait."""
        while len(self.waiting) > leave:
            demand = np.array([(p.length, 1, p.loss) for p in self.waiting], float) / self.most
            weight = demand.mean(axis=0)
            there = np.ones(len(demand), bool)
            rest, placed = np.ones(3), []
            while there.any():
                fits = there & (demand <= rest + 1e-9).all(axis=1)
                if fits.any():
                    # the first of the best: ties go to the item that waited longest
                    k = int(np.where(fits, demand @ (weight * rest), -1.0).argmax())
                    placed.append(self.waiting[k])
                    there[k] = False
                    rest = rest - demand[k]
                    continue
                tokens, segments, loss = np.rint(rest * self.most).astype(int)
                if not self.cut or tokens < 1 or segments < 1:
                    break
                k = int(np.where(there, demand[:, 0], -1.0).argmax())
                whole = self.waiting[k]
                part = self._head(whole, int(tokens), int(loss))
                if part.length < 1:
                    break
                placed.append(part)
                self.waiting[k] = Piece(
                    whole.item, whole.start + part.length, whole.length - part.length, whole.loss - part.loss
                )
                demand[k] = np.array([self.waiting[k].length, 1, self.waiting[k].loss]) / self.most
                break
            if not placed:
                raise ValueError(f"nothing fits an empty sequence of {self.limits}")
            self.waiting = [p for p, left in zip(self.waiting, there, strict=True) if left]
            self._close(placed)

    def _close(self, pieces: list[Piece]) -> None:
        """Number the sequence; one that ends short is cut into sequences whose lengths are powers of two."""
        total = sum(p.length for p in pieces)
        sizes = [total]
        if self.cut and total != self.limits.tokens:
            sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        left = list(reversed(pieces))
        for size in sizes:
            own, offset = [], 0
            while offset < size:
                piece = left.pop()
                part = self._head(piece, size - offset, piece.loss)
                if part.length < piece.length:
                    left.append(
                        Piece(piece.item, piece.start + part.length, piece.length - part.length, piece.loss - part.loss)
                    )
                part.sequence, part.offset = self.sequence, offset
                offset += part.length
                own.append(part)
            self.sequence += 1
            self.done(own)


def _sequence_base() -> int:
    """Sequence numbers of a task start here: unique over the job, the same when a task runs again."""
    return TaskContext.get().partitionId() << 40


PIECES = (
    "doc_id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary"
)


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 2,
    limits: Limits = Limits(),
) -> DataFrame:
    """Tokenize whole texts and pack them; one row per piece.

    `ids` holds the piece's ids as little-endian unsigned 32-bit integers, `start` the ids of its document before it,
    `doc_tokens` all ids of the document with the end id, `offset` the ids before it in its sequence. All tokens of a
    plain document bear loss. A null or empty text is the end id alone. Rows with equal ids or texts are packed each for
    itself; a null id stays null. An empty table gives no rows. Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer).encode, _sequence_base()
        kept: dict[int, list] = {}  # item -> [doc_id, ids, ids not yet placed]
        rows: list[tuple] = []

        def done(pieces: list[Piece]) -> None:
            for p in pieces:
                own = kept[p.item]
                ids = own[1][p.start : p.start + p.length].astype("<u4").tobytes()
                rows.append((own[0], p.start, p.length, len(own[1]), p.loss, base + p.sequence, p.offset, ids))
                own[2] -= p.length
                if not own[2]:
                    del kept[p.item]

        packer, item = Packer(limits, True, done), 0
        for batch in batches:
            for part in text_slices(batch, text_column):
                ids, ends = encode(part.column(text_column), end_id)
                first = 0
                for doc, last in zip(part.column(id_column).to_pylist(), ends.tolist(), strict=True):
                    own = ids[first:last].copy()
                    kept[item] = [doc, own, len(own)]
                    packer.add(item, len(own), len(own))
                    first, item = last, item + 1
                    if len(rows) >= 4096:
                        yield _batch(rows, PIECES_ARROW)
                        rows.clear()
        packer.finish()
        if rows:
            yield _batch(rows, PIECES_ARROW)

    return df.select(id_column, text_column).mapInArrow(run, PIECES)


PIECES_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "loss_tokens", "sequence_id", "offset")]
    + [("ids", pa.binary())]
)
PLACES = "item_id long, start long, length long, loss_tokens long, sequence_id long, offset long"
PLACES_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("item_id", "start", "length", "loss_tokens", "sequence_id", "offset")]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def pack_examples(
    df: DataFrame,
    id_column: str,
    tokens_column: str,
    loss_column: str,
    limits: Limits = Limits(),
    cut: bool = False,
) -> DataFrame:
    """Place instruction examples of known size: (item_id, start, length, loss_tokens, sequence_id, offset).

    By default examples stay whole and one over a limit gets a sequence of its own. A null count is 0; an example
    without tokens gets no row; loss beyond the tokens counts as the tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, names, rows = _sequence_base(), {}, []

        def done(pieces: list[Piece]) -> None:
            rows.extend((names[p.item], p.start, p.length, p.loss, base + p.sequence, p.offset) for p in pieces)

        packer = Packer(limits, cut, done)
        for batch in batches:
            for name, tokens, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names[len(names)] = name
                packer.add(len(names) - 1, tokens or 0, min(tokens or 0, loss or 0)) if tokens else None
            if rows:
                yield _batch(rows, PLACES_ARROW)
                rows.clear()
        packer.finish()
        if rows:
            yield _batch(rows, PLACES_ARROW)

    narrow = df.selectExpr(f"cast(`{id_column}` as long)", f"cast(`{tokens_column}` as long)", f"cast(`{loss_column}` as long)")
    return narrow.mapInArrow(run, PLACES)
