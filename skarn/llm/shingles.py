"""Sets of word shingles of whole texts, as sorted 64-bit hashes, by array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from skarn.llm._words import plain, raw_bytes

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, bounds of each text). Words: runs without space and bytes 9 to 13, A-Z in lower case."""
    raw, places = raw_bytes(plain(texts))
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    raw = low[raw]
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins, ends = ~blank, ~blank
    begins[1:] &= blank[:-1]
    ends[:-1] &= blank[1:]
    inner = places[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] = ~blank[inner]
    ends[inner - 1] = ~blank[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(first):
        return np.empty(0, U), np.searchsorted(first, places)
    # eight letters at a time, each eight mixed with its place in the word: sums of them have no structure to collide by
    lengths = last - first
    n = (lengths + 7) // 8
    before = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(before, n)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(raw) + 1, "<u8", padded.data, strides=(1,))[np.repeat(first, n) + 8 * place]
    short = np.repeat(lengths, n) - 8 * place
    eights &= np.where(short >= 8, ~U(0), (U(1) << (U(8) * np.minimum(short, 7).astype(U))) - U(1))
    mixed = mix(eights ^ mix((place + 1).astype(U) * BASE))
    return mix(np.add.reduceat(mixed, before) + lengths.astype(U)), np.searchsorted(first, places)


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending. A text of fewer words is one shingle; one without words has none."""
    return [own for own, _ in sets_of_words(*word_hashes(texts), size)]


def sets_of_words(words: np.ndarray, bounds: np.ndarray, size: int = 5, weights: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """`shingle_sets` of hashed words, each shingle with the sum of its words' weights if there is one for each word."""
    factors = mix(np.arange(101, 101 + size, dtype=U) * BASE) | U(1)
    n = len(words)
    rolled, sums = np.zeros(max(0, n - size + 1), U), np.zeros(max(0, n - size + 1), np.uint16)
    for k in range(size):
        rolled += words[k : n - size + 1 + k] * factors[k] if n >= size else 0
        if weights is not None and n >= size:
            sums += weights[k : n - size + 1 + k]
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            own, weight = rolled[a : b - size + 1], None
            if weights is None:
                own = np.sort(own)
            else:
                order = np.argsort(own)
                own, weight = own[order], sums[a : b - size + 1][order]
            first = np.concatenate(([True], own[1:] != own[:-1]))
            yield own[first], None if weights is None else weight[first]
        elif b > a:
            own = (words[a:b] * factors[: b - a]).sum(dtype=U) + U(b - a)
            yield mix(np.array([own], U)), None if weights is None else weights[a:b].sum(dtype=np.uint16, keepdims=True)
        else:
            yield np.empty(0, U), None if weights is None else np.empty(0, np.uint16)


def parity(shingles: np.ndarray) -> bytes:
    """One bit per cell: does it hold an odd number of the shingles? Of two cells for each shingle, about, a power of two.

    The bits in which two sets differ are no more than the shingles in which they differ; see `apart`.
    """
    cells = 1 << min(17, max(9, int(2 * len(shingles) - 1).bit_length()))
    return np.packbits(np.bincount((shingles & U(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities of fewer cells: what `parity` gives for so many, as 64-bit words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def apart(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Lower bounds of the shingles in which a set and each of some others differ, from their parities as 64-bit words."""
    sizes = np.array([len(o) for o in others])
    out = np.zeros(len(others), np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        words = min(int(size), len(one))
        theirs = np.stack([folded(others[k], words) for k in at])
        out[at] = np.bitwise_count(theirs ^ folded(one, words)).sum(axis=1, dtype=np.int64)
    return out


def fingerprint(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set; 0 for the empty set."""
    if not len(shingles):
        return 0
    name = mix(np.array([mix(shingles ^ BASE).sum(dtype=U) + U(len(shingles))], U))
    return int(name.view(np.int64)[0])
