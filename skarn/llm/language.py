"""Language identification by unigrams over a fixed public vocabulary, with segmentations summed out.

Each language has a probability for every piece of a SentencePiece vocabulary. The probability of a word in a language is
the sum over all ways to cut it into pieces of the product of their probabilities (a forward pass over its characters),
and that of a text the product over its words. Pieces never reach across white space, so the sum over all segmentations
of a text is the product of the sums of its words, and each distinct word of a batch is scored once.

The piece probabilities are fitted by expectation maximisation (forward and backward passes give the expected uses of
each piece) on at most `sample` labelled texts outside the held-out fold, spread evenly over the languages. Scoring
covers every text whole.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm._shared import release, stored, text_slices
from skarn.llm._words import plain, words_of

SAMPLE = 1200  # labelled texts of each language at most
WORDS = 40_000  # distinct training words at most, the most frequent of each language
ROUNDS = 4
SMOOTH = 0.1  # uses added to each piece of the vocabulary
SLICE = 8 << 20
SPACE = "▁"
UNKNOWN = -14.0  # log probability of a character that no piece covers
GROUP = 60_000  # words of a group times the letters of its longest
EDGES = ".,;:!?\"'()[]{}*#%&$…-_«»“”¿¡|/\\<>=+~`^@"


def vocabulary(path: str) -> dict[str, int]:
    """Piece -> number, without control pieces and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return {
        model.id_to_piece(k): k
        for k in range(n)
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
    }


def shaped(word: str) -> str:
    """A word as the vocabulary spells it, without marks at its ends; empty unless it holds a letter."""
    own = word.strip(EDGES)
    return SPACE + own if any(map(str.isalpha, own)) else ""


class Pieces:
    """Numbers of the pieces, and all beginnings of pieces, past which no longer piece can match."""

    def __init__(self, number: dict[str, int]):
        self.number = number
        self.starts = {p[:n] for p in number for n in range(2, len(p) + 1)}


class Lattice:
    """The pieces that match inside each of a list of words: arrays of (word, first, end, piece) grouped by end."""

    def __init__(self, words: list[str], pieces: Pieces):
        flat = array("q")
        add, number, starts = flat.extend, pieces.number.get, pieces.starts
        for w, word in enumerate(words):
            size = len(word)
            for a in range(size):
                add((a + 1, w, a, number(word[a], -1)))
                b = a + 2
                while b <= size and (part := word[a:b]) in starts:
                    if (k := number(part)) is not None:
                        add((b, w, a, k))
                    b += 1
        self.words, self.sizes = len(words), np.array([len(w) for w in words], np.int64)
        table = np.frombuffer(flat, np.int64).reshape(-1, 4)
        self.end, self.word, self.first, self.piece = table[np.lexsort((table[:, 1], table[:, 0]))].T
        self.steps = np.searchsorted(self.end, np.arange(1, int(self.sizes.max(initial=0)) + 2))

    def forward(self, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log alpha[word, place, language], log weight[arc, language]); `logs` is [piece + 1, language], unknown last."""
        weight = logs[self.piece]
        alpha = np.full((self.words, int(self.sizes.max(initial=0)) + 1, logs.shape[1]), -np.inf)
        alpha[:, 0] = 0.0
        for end, (a, b) in enumerate(zip(self.steps[:-1], self.steps[1:], strict=True), 1):
            if a == b:
                continue
            words = self.word[a:b]
            value = alpha[words, self.first[a:b]] + weight[a:b]
            heads = np.flatnonzero(np.diff(words, prepend=-1))
            top = np.maximum.reduceat(value, heads, axis=0)
            spread = np.repeat(top, np.diff(np.append(heads, b - a)), axis=0)
            alpha[words[heads], end] = top + np.log(np.add.reduceat(np.exp(value - spread), heads, axis=0))
        return alpha, weight

    def totals(self, logs: np.ndarray) -> np.ndarray:
        """log probability of each word in each language, all segmentations summed."""
        alpha, _ = self.forward(logs)
        return alpha[np.arange(self.words), self.sizes]

    def uses(self, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, words weighted by `counts` [word, language]."""
        alpha, weight = self.forward(logs)
        beta = np.full(alpha.shape, -np.inf)
        beta[np.arange(self.words), self.sizes] = 0.0
        # arcs by their first place, from the right
        order = np.lexsort((self.word, self.first))
        first, words, end = self.first[order], self.word[order], self.end[order]
        steps = np.searchsorted(first, np.arange(alpha.shape[1] + 1))
        for place in reversed(range(alpha.shape[1])):
            a, b = steps[place], steps[place + 1]
            if a == b:
                continue
            value = beta[words[a:b], end[a:b]] + weight[order[a:b]]
            heads = np.flatnonzero(np.diff(words[a:b], prepend=-1))
            top = np.maximum.reduceat(value, heads, axis=0)
            spread = np.repeat(top, np.diff(np.append(heads, b - a)), axis=0)
            beta[words[a:b][heads], place] = top + np.log(np.add.reduceat(np.exp(value - spread), heads, axis=0))
        total = alpha[np.arange(self.words), self.sizes]
        share = np.exp(alpha[self.word, self.first] + weight + beta[self.word, self.end] - total[self.word])
        share *= counts[self.word]
        known = self.piece >= 0
        return np.stack([np.bincount(self.piece[known], s[known], len(logs) - 1) for s in share.T], axis=1)


@dataclass
class Model:
    languages: list[str]
    pieces: dict[str, int]
    logs: np.ndarray  # [piece + 1, language]


def fit(
    docs: DataFrame,
    vocabulary_path: str,
    sample: int = SAMPLE,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
    folds: int = 5,
    held_out: int = 0,
) -> Model:
    """Learn from about 0.8 * `sample` texts of each language outside the held-out fold, those with the smallest hashes of the id.

    A language of fewer texts than that gives all of them, or the share of the hashes that comes to 0.8 * `sample`. Rows that
    repeat an id are drawn together, so `sample` bounds ids, and `WORDS` what reaches the driver. Rows without id, text or language are left out. Without any row the model knows no language.
    """
    usable = docs.where(
        F.col(id_column).isNotNull() & F.col(text_column).isNotNull() & F.col(language_column).isNotNull()
        & (F.crc32(F.col(id_column).cast("string")) % folds != held_out)
    ).select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), F.col(language_column).alias("_lang"))
    # the `sample`-th smallest hash of each language, from ids and languages alone
    hashed = F.xxhash64(F.col("_id").cast("string"))
    sizes = {r["_lang"]: r["n"] for r in usable.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    # a share of the hashes that gives about 0.8 of the bound
    limits = {k: int(min(1.0, 0.8 * sample / n) * (1 << 30)) for k, n in sizes.items()}
    draw = F.pmod(hashed, F.lit(1 << 30))
    limit = F.coalesce(*[F.when(F.col("_lang") == k, F.lit(v)) for k, v in limits.items()], F.lit(0))
    chosen = usable.where(draw < limit) if limits else usable

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist(), strict=True):
                count.update((lang, w) for w in map(shaped, text.lower().split()) if w)
        keys = list(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([count[k] for k in keys], pa.int64())],
            ["lang", "word", "n"],
        )

    table = stored(
        chosen.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words"
    )
    languages = sorted(sizes)
    pieces = vocabulary(vocabulary_path)
    size = max(pieces.values()) + 1
    frequent: dict[str, np.ndarray] = {}
    for k, lang in enumerate(languages):
        rows = table.where(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(WORDS // max(1, len(languages)))
        for r in rows.collect():  # bounded by WORDS
            frequent.setdefault(r["word"], np.zeros(len(languages)))[k] = r["n"]
    words = sorted(frequent)
    logs = np.full((size + 1, len(languages)), np.log(1 / size))
    logs[size] = UNKNOWN
    if words:
        matched = Pieces(pieces)
        counts = np.stack([frequent[w] for w in words])
        for _ in range(ROUNDS):
            used = np.full((size, len(languages)), SMOOTH)
            for some in like_long(words):
                used += Lattice([words[k] for k in some], matched).uses(logs, counts[some])
            logs[:size] = np.log(used / used.sum(axis=0))
    return Model(languages, pieces, logs)


def like_long(words: list[str]) -> Iterator[np.ndarray]:
    """Positions of words in groups of like length: a forward pass is as long as the longest word of its group."""
    order = np.array(sorted(range(len(words)), key=lambda k: len(words[k])), np.int64)
    first = 0
    for at, k in enumerate(order.tolist()):
        if at > first and (at - first + 1) * len(words[k]) > GROUP:
            yield order[first:at]
            first = at
    if len(order):
        yield order[first:]


class Scores:
    """distinct word -> log probabilities per language, remembered up to a bound."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most, self.pieces = model, most, Pieces(model.pieces)
        self.place: dict[str, int] = {"": 0}  # of words and their forms in `rows`
        self.rows = np.zeros((1, len(model.languages)))

    def of(self, words: list[str]) -> np.ndarray:
        if not self.model.languages:
            return np.zeros((len(words), 0))
        forms = {w: f for w in words if w not in self.place and (f := shaped(w)) not in self.place}
        new = sorted(set(forms.values()), key=len)
        found = [self.rows] + [Lattice([new[k] for k in some], self.pieces).totals(self.model.logs) for some in like_long(new)]
        rows, first = np.concatenate(found), len(self.rows)
        place = dict(zip(new, range(first, first + len(new)), strict=True))
        at = [
            self.place[w] if w in self.place else place[forms[w]] if w in forms else self.place[shaped(w)] for w in words
        ]
        if len(self.place) < self.most:
            self.rows = rows
            self.place.update(place)
            self.place.update(zip(words, at, strict=True))
        return rows[at]


def classify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: str | bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, or all columns and the language under the name `keep` (True: `_lang_pred`).

    `lang_pred` is the likeliest learned language, the alphabetically first on a tie, `score` its share of the likelihoods
    at equal priors. A text that is null or has no letter, and any text when no language was learned, gets `und` and 0.
    Repeated rows are scored each for itself.
    """

    keep = "_lang_pred" if keep is True else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in batches:
            for rows in text_slices(batch, text_column, SLICE):
                codes, distinct, bounds = words_of(plain(rows.column(text_column)))
                each = scores.of(distinct)
                lettered = np.array([bool(shaped(w)) for w in distinct], np.int64)
                total = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each[codes], axis=0)])
                logs = total[bounds[1:]] - total[bounds[:-1]]
                letters = np.concatenate([[0], np.cumsum(lettered[codes])])
                some = letters[bounds[1:]] > letters[bounds[:-1]]
                if model.languages:
                    best = logs.argmax(axis=1)
                    share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    names = [model.languages[k] if ok else "und" for k, ok in zip(best.tolist(), some.tolist(), strict=True)]
                    share = np.where(some, share, 0.0)
                else:
                    names, share = ["und"] * rows.num_rows, np.zeros(rows.num_rows)
                found = [pa.array(names, pa.string()), pa.array(share, pa.float64())]
                if keep:
                    yield pa.RecordBatch.from_arrays([*rows.columns, found[0]], [*rows.schema.names, keep])
                else:
                    yield pa.RecordBatch.from_arrays([rows.column(id_column), *found], ["doc_id", "lang_pred", "score"])
        del scores
        release()

    if keep:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
        return docs.mapInArrow(run, ", ".join([*fields, f"`{keep}` string"]))
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
