"""Token ids of whole texts by the tokenizers library, with a cache of words.

A tokenizer whose pre-tokenizer drops white space gives each run between spaces the same ids wherever it stands. So a
batch of texts is cut at spaces, tabs and line feeds, only the distinct runs are encoded, and their ids are laid out by
array operations. Runs of plain Latin letters are cut into words as the tokenizer's own pattern does and each new word
goes to the library's model; any other run goes to the library whole. The cache stops growing at `CACHE` entries, which
bounds memory and leaves results as they are. A tokenizer of another make encodes each text in one call.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 700_000  # entries

# The pre-tokenizer pattern for which the cutting below holds.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

LETTERS = "a-zß-öø-ÿœ"
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿœŒ]+").fullmatch
CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+").findall


def _byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level tokenizer writes for each byte value."""
    own = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Runs(dict):
    """run of characters without white space -> its ids as bytes; words are runs as well."""

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self.tokenizer, self.kind = tokenizer, kind
        self.tokenize, self.letters = tokenizer.model.tokenize, _byte_letters()

    def __missing__(self, run: str) -> bytes:
        if not PLAIN(run):
            ids = array(self.kind, self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        elif len(words := CUT(run.lower())) > 1 or words[0] != run:
            ids = b"".join(map(self.__getitem__, words))
        else:
            shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
            ids = array(self.kind, [t.id for t in self.tokenize(shown)]).tobytes()
        if len(self) < CACHE and len(run) < 64:
            self[run] = ids
        return ids


class WordEncoder:
    """Encodes batches of texts; one per process and tokenizer file, see `encoder`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        folds = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        self.by_run = (
            folds == ["NFC", "Replace", "Lowercase"]
            and (steps[0].get("pattern") or {}).get("Regex") == WORDS
            and steps[0].get("behavior") == "Removed"
            and [x.get("type") for x in steps[1:]] == ["ByteLevel"]
        )
        self.runs = _Runs(self.tokenizer, "H" if self.dtype.itemsize == 2 else "I")
        gc.freeze()  # the cache holds no cycles: keep the collector from walking them
        gc.disable()

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids end). Null is an empty text; `end_id` closes each."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_run:
            tail = [] if end_id is None else [end_id]
            each = [
                np.array(x.ids + tail, self.dtype)
                for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            ]
            ends = np.cumsum([len(x) for x in each], dtype=np.int64)
            return (np.concatenate(each) if each else np.empty(0, self.dtype)), ends
        cut = pc.split_pattern(_spaced(texts), " ")
        runs = cut.flatten().dictionary_encode()
        ids = [*map(self.runs.__getitem__, runs.dictionary.to_pylist())]
        close = len(ids)
        ids.append(b"" if end_id is None else np.array([end_id], self.dtype).tobytes())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), self.dtype)
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py() if len(cut) else np.zeros(1, np.int64)
        codes = np.insert(runs.indices.to_numpy(), bounds[1:], close)
        each = sizes[codes]
        ends = np.cumsum(each)
        # token k of run j stands at first[j] + k in `flat`
        first = (np.cumsum(sizes) - sizes)[codes]
        places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - each), each)
        return flat[places], ends[bounds[1:] + np.arange(len(cut))]


def _spaced(texts: pa.Array) -> pa.Array:
    """Texts by bytes: tabs and line feeds as spaces, a space before a comma or stop that ends a word, A-Z as a-z.

    Beside combining marks, with which a small letter may compose where a capital does not, letters stay as they are.
    """
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.empty(0, np.uint8)
    places = places - places[0]
    change = np.arange(256, dtype=np.uint8)
    change[[9, 10]] = 32
    if not np.isin(raw, np.array([0xCC, 0xCD], np.uint8)).any():
        change[65:91] += 32
    raw = change[raw]
    mark = np.flatnonzero((raw == 44) | (raw == 46))
    mark = mark[(mark > 0) & (mark + 1 < len(raw))]
    mark = mark[(raw[mark - 1] >= 97) & (raw[mark - 1] <= 122) & (raw[mark + 1] == 32)]
    raw = np.insert(raw, mark, 32)
    places = places + np.searchsorted(mark, places)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(places), pa.py_buffer(raw))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
