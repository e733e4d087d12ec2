"""Byte-level BPE of whole texts with the tiktoken library and a local rank file, and back to bytes.

A long text is cut ahead of the library where no match of the pattern can reach across: before a blank or line feed that
follows a character which is no white space. No alternative of the pattern takes white space after other characters, and
its only lookahead belongs to a match of white space alone, so both sides match as they do in the whole text.

A very long run of white space, on which the library's matcher fails, never reaches it: the pattern takes such a run as one
match up to its last character (to its end, where the text ends), so that match goes straight to the pair merging.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skarn.llm._shared import text_slices, texts_of

LONG = 1 << 16  # characters handed to the library in one call, unless no safe boundary comes
SAFE = re.compile(r"(?<=\S)(?<![\x1c-\x1f])[ \n]")
BLANK = re.compile(r"[^\S\x1c-\x1f]{%d,}" % LONG)  # white space as the library knows it


def parts(text: str, size: int = LONG) -> Iterator[str]:
    """Consecutive parts of a text of about `size` characters, cut at safe boundaries only."""
    first = 0
    while len(text) - first > size:
        cut = SAFE.search(text, first + size)
        if not cut:
            break
        yield text[first : cut.start()]
        first = cut.start()
    yield text[first:] if first else text


class ByteBpe:
    """One rank file and pattern in one process."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for piece, k in ranks.items():
            self.bytes[k] = piece
        self.decimal = [b"%d," % k for k in range(len(self.bytes))]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the strings of special tokens are ordinary text."""
        if len(text) <= LONG:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        first = 0
        for run in BLANK.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self._plain(text[first : run.start()])
            ids += self.encoding._encode_single_piece(text[run.start() : end])
            first = end
        return ids + self._plain(text[first:])

    def _plain(self, text: str) -> list[int]:
        return [k for part in parts(text) for k in self.encoding.encode_ordinary(part)]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; raises on an id without a rank."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def listed(self, ids: list[int]) -> bytes:
        """Decimal ids joined by commas."""
        return b"".join(map(self.decimal.__getitem__, ids))[:-1]


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): `ids` as little-endian unsigned 32-bit integers in one binary value.

    A null text counts as empty and has no ids. Rows that repeat are encoded each for itself, an id may be null, an empty
    table gives no rows, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for rows in text_slices(batch, text_column, 2 << 20):
                each = [bpe.encode(t) for t in texts_of(rows, text_column)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column(id_column).cast(pa.int64()),
                        "n_tokens": pa.array([len(x) for x in each], pa.int64()),
                        "ids": pa.array([np.array(x, "<u4").tobytes() for x in each], pa.binary()),
                    }
                )

    return df.select(id_column, text_column).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_ids(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, listed, decoded) of the result of `encode_texts`, or of any such table.

    `listed`: decimal ids joined by commas. `decoded`: their raw bytes, which need not be valid UTF-8 when the ids are
    not those of a text. Null ids count as none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for rows in text_slices(batch, "ids", 2 << 20):
                each = [np.frombuffer(x or b"", "<u4").tolist() for x in rows.column("ids").to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id"),
                        "n_tokens": rows.column("n_tokens"),
                        "listed": pa.array(map(bpe.listed, each), pa.binary()),
                        "decoded": pa.array(map(bpe.decode, each), pa.binary()),
                    }
                )

    return df.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, listed binary, decoded binary"
    )
