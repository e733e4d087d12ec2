"""Spelling variants by a trie over letter-group counts.

Words are counted first: maximal runs of Latin letters, with their ASCII capitals lowered. Their counts of letters by
group are then the levels of a trie, `COARSE` wide groups first and the `FINE` narrow ones after them. An edit adds one
letter, takes one away, or does both, so a near word lies at a leaf whose counts exceed those of the word by one in all at
most (surplus) and fall short by one in all at most (deficit), for the wide groups and for the narrow ones. A depth-first
search spends that budget; all words that ask go down the trie together, and what reaches a leaf is verified.

On a cluster the trie is cut below its first levels: a word lives in the cell of its first counts and asks in every cell
that its budget reaches. The depth of the cut is the least at which the mean cell is small, and a cell that is still large
is dealt into parts, each a trie of its own in which all words that reach the cell ask. A task returns one row per asking
word, never pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm._shared import drop_stored, stored

COARSE, FINE = 8, 26
CELL = 8192  # words of one trie, about
CELL_BYTES = 32 << 20
ASKING = 65_536  # words that go down a trie together
SLICE = 4 << 20  # bytes of a text cut into words at a time
WIDTH = 32  # letters of a word held in arrays, from its start and from its end
LEAF, LEAF_PAIRS = 8, 4096  # a node of so few words, or of so few pairs with those that ask, is a leaf
PAIRS = 1 << 18  # pairs verified at a time
FLUSH = 200_000  # counted words after which a task passes them on

_BYTES = np.arange(256)
_IS_LETTER = (_BYTES >= 65) & (_BYTES <= 90) | (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 0xC0)
_CHANGE = bytes((b + 32 if 65 <= b <= 90 else b) if _IS_LETTER[b] else 32 for b in range(256))
_NARROW = np.where(_BYTES >= 0xC0, (_BYTES - 0xC0) % FINE, (_BYTES - 97) % FINE)
_WIDE = _BYTES % COARSE


def runs(text: str) -> Counter:
    """The runs of `[A-Za-z\\u00C0-\\u00FF]+` of a text with A-Z lowered, as Latin-1 bytes, and their number."""
    letters = text.encode("latin-1", "replace").translate(_CHANGE)
    found: Counter = Counter()
    at = 0
    while at < len(letters):
        end = len(letters) if len(letters) - at <= SLICE else letters.find(b" ", at + SLICE)
        end = len(letters) if end < 0 else end
        found.update(letters[at:end].split())
        at = end
    return found


def spoiled(doc_id: int | None, run: bytes, drop: int) -> bytes:
    """The run as it counts: one code point less where the checksum of document and run is a multiple of `drop`."""
    utf8 = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(utf8, zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id))
    if h % drop:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(drop: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in part], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(part.values()), pa.int64())], ["word", "n"])
            part.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for w, n in runs(text.as_py() or "").items():
                    # as in `spoiled`, which is spelt out for the speed of this loop
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % drop == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                    if len(w) >= shortest:
                        part[w] += n
                if len(part) >= FLUSH:
                    yield rows()
        yield rows()

    return run


def word_counts(docs: DataFrame, drop: int = 97, shortest: int = 5, least: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n) of the words of at least `shortest` code points that occur at least `least` times in all texts.

    A null text has no words; a null id stands for no characters in the checksum. Rows that repeat an id count each.
    """
    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("text is not null")
    parts = read.mapInArrow(_counted(drop, shortest), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def group_counts(words: list[bytes]) -> np.ndarray:
    """Counts of the wide groups, then of the narrow ones, per word; 255 stands for more.

    Near words differ by no more after that limit than before.
    """
    n = len(words)
    letters = np.frombuffer(b"".join(words), np.uint8)
    owner = np.repeat(np.arange(n), [len(w) for w in words])
    wide = np.bincount(owner * COARSE + _WIDE[letters], minlength=n * COARSE).reshape(n, COARSE)
    narrow = np.bincount(owner * FINE + _NARROW[letters], minlength=n * FINE).reshape(n, FINE)
    return np.minimum(np.concatenate([wide, narrow], axis=1), 255).astype(np.int16)


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _reach(depth: int) -> list[np.ndarray]:
    """All changes of the first `depth` counts that one surplus and one deficit allow, none first."""
    one = np.eye(depth, dtype=np.int16)
    out = [np.zeros(depth, np.int16), *one, *-one]
    return out + [one[i] - one[j] for i in range(depth) for j in range(depth) if i != j]


def _code(counts: np.ndarray) -> np.ndarray:
    code = np.zeros(len(counts), np.uint64)
    for g in range(counts.shape[1]):
        code = code << np.uint64(8) | counts[:, g].astype(np.uint64)
    return code.view(np.int64)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, cell, size): the word's cell at every depth."""
    for batch in batches:
        words = _latin(batch.column("word"))
        counts = group_counts(words)
        size = pa.array([len(w) for w in words], pa.int64())
        for depth in range(1, COARSE + 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array([depth] * len(words), pa.int32()), pa.array(_code(counts[:, :depth])), size], ["depth", "cell", "size"]
            )


def _routed(depth: int):
    changes = _reach(depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = group_counts(_latin(batch.column("word")))[:, :depth]
            for change in changes:
                there = counts + change
                rows = np.flatnonzero((there >= 0).all(axis=1) & (there <= 255).all(axis=1))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_code(there[rows])), pa.array(np.full(len(rows), not change.any())), batch.column("word").take(take), batch.column("n").take(take)],
                    ["cell", "lives", "word", "n"],
                )

    return run


class Words:
    """Words as arrays: counts, the first and last `WIDTH` letters, lengths."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        self.words, self.n = words, n
        self.counts = group_counts(words)
        self.length = np.array([len(w) for w in words], np.int64)
        self.head = np.frombuffer(b"".join(w[:WIDTH].ljust(WIDTH, b"\0") for w in words), np.uint8).reshape(-1, WIDTH)
        self.tail = np.frombuffer(b"".join(w[-WIDTH:].rjust(WIDTH, b"\0") for w in words), np.uint8).reshape(-1, WIDTH)
        # one bit per narrow group that occurs, and one per group that occurs twice
        bits = np.left_shift(np.uint64(1), np.arange(FINE, dtype=np.uint64))
        narrow = self.counts[:, COARSE:]
        self.letters = (narrow > 0) @ bits | ((narrow > 1) @ bits) << np.uint64(FINE)


def near(a: bytes, b: bytes) -> bool:
    """Do two words differ by exactly one inserted, deleted or replaced letter?"""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(a) == len(b):
        return int((x != y).sum()) == 1
    apart = np.flatnonzero(x[:short] != y[:short])
    back = np.flatnonzero(x[::-1][:short] != y[::-1][:short])
    same = (int(apart[0]) if len(apart) else short) + (int(back[0]) if len(back) else short)
    return same >= short


class Trie:
    """The words of one cell in the order of their counts; a node is a stretch of them that agree up to its level."""

    def __init__(self, members: Words):
        order = np.lexsort(members.counts.T[::-1])
        self.words = [members.words[k] for k in order]
        self.n, self.counts, self.length = members.n[order], members.counts[order], members.length[order]
        self.head, self.tail, self.letters = members.head[order], members.tail[order], members.letters[order]
        # ranks by number of occurrences, ties by code points
        self.rank = np.empty(len(order), np.int64)
        ranked = sorted(range(len(order)), key=lambda k: (-int(self.n[k]), self.words[k]))
        self.rank[ranked] = np.arange(len(order))
        self.ranked = np.array(ranked, np.int64)

    def ask(self, asking: Words) -> tuple[np.ndarray, np.ndarray]:
        """Per asking word: how many words here are near, and the position of the first by rank (-1: none)."""
        found = np.zeros(len(asking.words), np.int64)
        first = np.full(len(asking.words), len(self.words), np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def verify() -> None:
            nonlocal held
            if pairs:
                who, what = (np.concatenate(side) for side in zip(*pairs, strict=True))
                good = self.verified(asking, who, what)
                np.add.at(found, who[good], 1)
                np.minimum.at(first, who[good], self.rank[what[good]])
                pairs.clear()
                held = 0

        everyone = np.arange(len(asking.words))
        stack = [(0, len(self.words), 0, everyone, np.zeros((2, len(everyone)), np.int8))]
        levels = self.counts.shape[1]
        while stack:
            lo, hi, level, who, spent = stack.pop()
            size = hi - lo
            if level == levels or size <= LEAF or len(who) * size <= LEAF_PAIRS:
                step = max(1, PAIRS // size)
                for part in range(0, len(who), step):
                    some = who[part : part + step]
                    theirs, ours = asking.letters[some][:, None], self.letters[None, lo:hi]
                    fits = (np.bitwise_count(ours & ~theirs) <= 1) & (np.bitwise_count(theirs & ~ours) <= 1)
                    i, j = np.nonzero(fits)
                    pairs.append((some[i], j + lo))
                    held += len(i)
                    if held >= PAIRS:
                        verify()
                continue
            here = self.counts[lo:hi, level]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(here)) + 1, [size]]) + lo
            asked = asking.counts[who, level]
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                kept, left = self.step(self.counts[start, level], asked, who, spent, level)
                if len(kept):
                    stack.append((start, end, level + 1, kept, left))
        verify()
        return found, np.where(first < len(self.words), self.ranked[np.minimum(first, len(self.words) - 1)], -1)

    @staticmethod
    def step(count: int, asked: np.ndarray, who: np.ndarray, spent: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Who can still pay after one more level; the budget begins anew with the narrow groups."""
        more = count - asked
        if level == COARSE:
            spent = np.zeros_like(spent)
        surplus, deficit = spent[0] + np.maximum(more, 0), spent[1] + np.maximum(-more, 0)
        keep = (surplus <= 1) & (deficit <= 1)
        return who[keep], np.stack([surplus[keep], deficit[keep]]).astype(np.int8)

    def verified(self, asking: Words, who: np.ndarray, what: np.ndarray) -> np.ndarray:
        a, b = asking.length[who], self.length[what]
        head = asking.head[who] != self.head[what]
        tail = (asking.tail[who] != self.tail[what])[:, ::-1]
        start = np.where(head.any(axis=1), head.argmax(axis=1), WIDTH)
        end = np.where(tail.any(axis=1), tail.argmax(axis=1), WIDTH)
        short = np.minimum(a, b)
        good = np.where(a == b, head.sum(axis=1) == 1, (abs(a - b) == 1) & (start + end >= short))
        for k in np.flatnonzero((np.maximum(a, b) > WIDTH) & (abs(a - b) <= 1)):  # longer than the arrays hold
            good[k] = near(asking.words[who[k]], self.words[what[k]])
        return good


ASKED = "word string, n long, n_near long, form string, form_n long"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell and part, the words that live there first; one row per asking word that is near some."""
    key, trie = None, None
    members: list[pa.RecordBatch] = []
    asking: list[pa.RecordBatch] = []
    held = 0

    def words(rows: list[pa.RecordBatch]) -> Words:
        table = pa.Table.from_batches(rows)
        return Words(_latin(table.column("word")), table.column("n").to_numpy())

    def answer(some: Words) -> Iterator[pa.RecordBatch]:
        if trie is not None and some.words:
            found, best = trie.ask(some)
            rows = np.flatnonzero(found)
            form = [trie.words[k].decode("latin-1") for k in best[rows]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([some.words[k].decode("latin-1") for k in rows], pa.string()),
                    pa.array(some.n[rows]),
                    pa.array(found[rows]),
                    pa.array(form, pa.string()),
                    pa.array(trie.n[best[rows]]),
                ],
                ["word", "n", "n_near", "form", "form_n"],
            )

    def settle() -> Iterator[pa.RecordBatch]:
        """The words that live here are complete: build their trie and let them ask."""
        nonlocal trie
        if members:
            own = words(members)
            members.clear()
            trie = Trie(own)
            yield from answer(own)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if asking:
            some = words(asking)
            asking.clear()
            held = 0
            yield from answer(some)

    for batch in batches:
        cell, part, lives = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "lives"))
        change = (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (lives[1:] != lives[:-1])
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]]).tolist()
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start == end:
                continue
            rows = batch.slice(start, end - start)
            if (cell[start], part[start]) != key:
                yield from settle()
                yield from flush()
                key, trie = (cell[start], part[start]), None
            if lives[start]:
                members.append(rows)
                continue
            yield from settle()
            asking.append(rows)
            held += len(rows)
            if held >= ASKING:
                yield from flush()
    yield from settle()
    yield from flush()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of the words that have near ones: the near word of largest n, whatever its n.

    `words` holds distinct words of Latin letters and their n; it is read several times. Ties go to the smallest word.
    """
    measured = words.mapInArrow(_cells, "depth int, cell long, size long")
    cells = stored(measured.groupBy("depth", "cell").agg(F.count(F.lit(1)).alias("words"), F.sum("size").alias("bytes")), "cells")
    means = cells.groupBy("depth").agg((F.sum("words") / F.count(F.lit(1))).alias("mean")).collect()  # 8 rows
    depth = min([r["depth"] for r in means if r["mean"] <= CELL // 4], default=COARSE)
    parts = F.ceil(F.greatest(F.col("words") / CELL, F.col("bytes") / CELL_BYTES)).cast("int")
    here = cells.where(F.col("depth") == depth).select("cell", parts.alias("parts"))
    routed = words.mapInArrow(_routed(depth), "cell long, lives boolean, word string, n long").join(here, "cell")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    dealt = routed.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), (F.col("lives")).alias("home"), own.alias("own"), "word", "n")
    dealt = dealt.select("cell", "part", (F.col("home") & (F.col("part") == F.col("own"))).alias("lives"), "word", "n")
    found = (
        dealt.repartition("cell", "part")
        .sortWithinPartitions("cell", "part", F.col("lives").desc())
        .mapInArrow(_asked, ASKED)
        .groupBy("word", "n")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    )
    out = stored(found.select("word", "n", "n_near", "best.form", (-F.col("best.n")).alias("form_n")), "near")
    drop_stored(cells)
    return out


def variants(
    docs: DataFrame, drop: int = 97, shortest: int = 5, least: int = 3, factor: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of `word_counts`.

    `form` is the near word of largest n (ties: the smallest in code-point order) where that n is at least `factor` times
    the word's own, else null, and `form_n` its n; `root` is reached from the word over forms. Texts that are null or
    empty have no words, and an empty table gives no rows. Columns other than id and text are not read.
    """
    if factor <= 1:
        raise ValueError("a form must occur more often than its word")
    words = stored(word_counts(docs, drop, shortest, least, id_column, text_column), "words")
    near_by = near_words(words)
    good = F.col("form_n") >= factor * F.col("n")
    forms = near_by.select("word", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    every = words.join(forms, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n")
    return every.join(roots(forms.where("form is not null").select("word", "form")), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word that has a form. Every round doubles the steps taken, and n at least doubles with a step."""
    links = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        there = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = stored(links.join(there, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        drop_stored(links)
        links = moved
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
