"""Cutting batches of texts at white space by array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def plain(texts: pa.Array) -> pa.Array:
    """Texts as large strings, null as empty."""
    return pc.fill_null(texts.cast(pa.large_string()), "")


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes of the texts of `plain`, where each text begins and the last one ends)."""
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, places - places[0]


def rebuilt(raw: np.ndarray, places: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(raw))


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of the word at each place, the distinct words, bounds of each text in the places).

    Words are what stands between spaces, tabs, line feeds and carriage returns, in lower case. A doubled separator
    makes an empty word.
    """
    raw, places = raw_bytes(pc.utf8_lower(texts))
    change = np.arange(256, dtype=np.uint8)
    change[[9, 10, 13]] = 32
    cut = pc.split_pattern(rebuilt(change[raw], places), " ")
    coded = cut.flatten().dictionary_encode()
    bounds = cut.offsets.to_numpy() if len(cut) else np.zeros(1, np.int64)
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), bounds - bounds[0]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each stretch; 0 for an empty one."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def peaks(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Largest value of each stretch; 0 for an empty one."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.maximum.reduceat(values, bounds[full])
    return out
