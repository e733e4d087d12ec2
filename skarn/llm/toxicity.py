"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities and peaks of a lexicon, hits near the second person, rates of capitals, punctuation,
symbols and digits, and words whose letters are hidden behind digits or symbols. The lexicon weighs whole words and word
beginnings by the log ratio of their document frequencies in toxic and other training texts; a term counts only when it
follows enough different words, so that the words of one often copied text do not become terms. A short list of common
insults joins it.

Trees and lexicon are fitted on at most `sample` labelled rows (the smallest by a hash of the id). Features of training
rows come from the lexicon of the other half of the rows, so that the trees see it as new texts will. Everything else
covers all rows: each text is scored where it lies, whole, in one pass.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm._shared import release, stored, text_slices
from skarn.llm._words import peaks, plain, raw_bytes, sums, words_of
from skarn.llm.boosting import Trees, calibrated, fit_trees, isotonic

SAMPLE = 20_000  # labelled rows at most for the fit
STRONG = 2.5  # weight from which a term counts as a hit
LEAST = 4  # toxic texts, and different words before the term, that a term needs at least
SHARE = 0.01  # the same as a share of the toxic texts
HEADS = range(3, 8)  # letters of word beginnings
SLICE = 4 << 20  # bytes of text measured at once
NEAR = 6  # places between a hit and a word of the second person

# Common insults, and words of the second person in English, German, French and Spanish.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting dumb fool jerk bastard bitch asshole"
SECOND = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros"
# Letters that digits and symbols stand for.
HIDDEN = str.maketrans("0134578@$!|", "oieastbasil")

EDGES = ".,;:!?\"'()[]{}*#%&…-_«»“”¿¡"
LETTERS = re.compile(r"[^\W\d_]")
MIXED = re.compile(r"[^\W\d_].*[\W\d_].*[^\W\d_]|[0-9@$!|].*[^\W\d_]")


def keys_of(word: str) -> list[str]:
    """The terms of a word: itself and its beginnings, which end in an asterisk."""
    return [word, *(word[:n] + "*" for n in HEADS if n < len(word))]


def bare(word: str) -> str:
    return word.strip(EDGES)


def shown(word: str) -> str:
    """A word with hidden letters made plain: digits and symbols replaced, other marks taken out."""
    return "".join(c for c in word.translate(HIDDEN) if LETTERS.match(c))


@dataclass
class Model:
    weights: dict[str, float]
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.empty(0), np.empty(0)))

    def weight(self, word: str) -> float:
        return max((self.weights.get(k, 0.0) for k in keys_of(word)), default=0.0)


class Words(dict):
    """distinct word -> (weight, weight once hidden letters are plain, second person, mixed), remembered up to a bound."""

    def __init__(self, model: Model, most: int = 300_000):
        super().__init__()
        self.model, self.most, self.second, self.insults = model, most, set(SECOND.split()), set(INSULTS.split())

    def __missing__(self, word: str) -> tuple[float, float, float, float, float]:
        own = bare(word)
        mixed = bool(MIXED.search(own)) and not own.isalpha()
        plain_form = shown(own) if mixed else own
        out = (
            self.model.weight(own),
            self.model.weight(plain_form) if mixed and len(plain_form) > 2 else 0.0,
            float(own in self.insults or (mixed and plain_form in self.insults)),
            float(own in self.second),
            float(mixed),
        )
        if len(self) < self.most:
            self[word] = out
        return out


def _byte_kinds() -> np.ndarray:
    """1 capital, 2 exclamation or question mark, 3 other ASCII mark, 4 digit, 5 small letter, 0 anything else."""
    kind = np.zeros(256, np.uint8)
    for c in range(33, 127):
        kind[c] = 3
    kind[[33, 63]] = 2
    kind[48:58], kind[65:91], kind[97:123] = 4, 1, 5
    return kind


def features(texts: pa.Array, words: Words) -> np.ndarray:
    """One row of features per text; a null or empty text has none of anything."""
    texts = plain(texts)
    codes, distinct, bounds = words_of(texts)
    per_word = np.array([words[w] for w in distinct], float).reshape(len(distinct), 5)
    filled = np.array([bool(w) for w in distinct], float)
    weight, hidden, insult, second, mixed = (per_word[codes, k] for k in range(5))
    both = np.maximum(weight, hidden)
    hit = (both >= STRONG).astype(float)
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # places since the last word of the second person, and until the next one, inside the same text
    at = np.flatnonzero(second)
    near = np.zeros(len(codes))
    if len(at) and len(codes):
        here = np.flatnonzero(hit)
        k = np.searchsorted(at, here)
        for other in (at[np.minimum(k, len(at) - 1)], at[np.maximum(k - 1, 0)]):
            near[here[(np.abs(other - here) <= NEAR) & (text_of[other] == text_of[here])]] = 1
    n = np.maximum(sums(filled[codes], bounds), 1)
    raw, places = raw_bytes(texts)
    kinds = _byte_kinds()[raw]
    rates = [sums(kinds == k, places) for k in (1, 2, 3, 4)]
    letters = np.maximum(rates[0] + sums(kinds == 5, places), 1)
    size = np.maximum(np.diff(places), 1)
    hits = sums(hit, bounds)
    columns = [
        hits,
        hits / n,
        sums(both, bounds) / n,
        peaks(both, bounds),
        sums(insult, bounds),
        sums(insult, bounds) / n,
        sums(near, bounds),
        sums(second, bounds) / n,
        sums(hidden >= STRONG, bounds),
        sums(mixed, bounds) / n,
        rates[0] / letters,
        rates[1] / size,
        rates[2] / size,
        rates[3] / size,
        np.log1p(n),
    ]
    return np.stack(columns, axis=1)


def fold(ids: list, parts: int) -> np.ndarray:
    """crc32 of each id's decimal text modulo `parts`; -1 for a null id."""
    return np.array([-1 if k is None else zlib.crc32(str(k).encode()) % parts for k in ids], np.int64)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    label: str = "toxic",
    id_column: str = "doc_id",
    text_column: str = "text",
    folds: int = 3,
    held_out: int = 1,
) -> Model:
    """Learn from labelled rows outside the held-out fold, at most `sample` of them.

    Repeated labels of an id count once, with the largest value; null labels and ids are left out. Without labels of both
    kinds the model gives every text the share of toxic labels (0.5 without any).
    """
    chosen = (
        labels.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_y"))
        .where("_id is not null and _y is not null")
        .where(F.crc32(F.col("_id").cast("string")) % folds != held_out)
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    # at most `sample` rows of two numbers: a proven bound
    rows = stored(
        docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        # of documents that repeat an id one counts, so that the bound holds for rows as it does for ids
        .groupBy("_id", "_y")
        .agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"))
        .select("_id", "_text", "_y"),
        "toxicity-sample",
    )

    def toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in text_slices(batch, "_text", SLICE // 4)):
            term, half, before = [], [], []
            for k, text in zip(fold(part.column("_id").to_pylist(), 2).tolist(), part.column("_text").to_pylist(), strict=True):
                words, seen = [bare(w) for w in text.lower().split()], set()
                for prior, word in zip(["", *words], words, strict=False):
                    for key in keys_of(word) if word else ():
                        if key not in seen:
                            seen.add(key)
                            term.append(key), half.append(k), before.append(prior)
            yield pa.RecordBatch.from_pydict({"term": pa.array(term, pa.string()), "half": pa.array(half, pa.int64()), "before": pa.array(before, pa.string())})

    totals = {(r["half"], r["_y"]): r["n"] for r in rows.groupBy((F.crc32(F.col("_id").cast("string")) % 2).alias("half"), "_y").agg(F.count("*").alias("n")).collect()}
    toxic = sum(n for (_, y), n in totals.items() if y == 1)
    least = max(LEAST, math.ceil(SHARE * toxic))
    found = (
        rows.where("_y = 1")
        .mapInArrow(toxic_terms, "term string, half long, before string")
        .groupBy("term", "half")
        .agg(F.count("*").alias("n"), F.countDistinct("before").alias("others"))
        .groupBy("term")
        .agg(
            F.sum(F.expr("if(half = 0, n, 0)")).alias("n0"),
            F.sum(F.expr("if(half = 1, n, 0)")).alias("n1"),
            F.sum("others").alias("others"),
        )
        .where((F.col("n0") + F.col("n1") >= least) & (F.col("others") >= least))
    )
    # terms of at least one toxic text in a hundred: bounded by the sample, whatever the size of the corpus
    in_toxic = {r["term"]: (r["n0"], r["n1"]) for r in found.collect()}

    def clean_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for k, text in zip(fold(batch.column("_id").to_pylist(), 2).tolist(), batch.column("_text").to_pylist(), strict=True):
                own = {key for w in set(text.lower().split()) for key in keys_of(bare(w)) if key in in_toxic}
                count.update((key, k) for key in own)
        keys = list(count)
        yield pa.RecordBatch.from_pydict({"term": pa.array([k[0] for k in keys], pa.string()), "half": pa.array([k[1] for k in keys], pa.int64()), "n": pa.array([count[k] for k in keys], pa.int64())})

    in_clean: dict[str, list[int]] = {}
    counted = rows.where("_y <> 1").mapInArrow(clean_terms, "term string, half long, n long").groupBy("term", "half").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most two rows per term of `in_toxic`
        in_clean.setdefault(r["term"], [0, 0])[r["half"]] = r["n"]

    def lexicon(halves: tuple[int, ...]) -> dict[str, float]:
        a = sum(totals.get((h, 1), 0) for h in halves) + 1
        c = sum(totals.get((h, 0), 0) for h in halves) + 1
        out = {}
        for term, n in in_toxic.items():
            own, other = sum(n[h] for h in halves), sum(in_clean.get(term, (0, 0))[h] for h in halves)
            value = math.log((own + 0.1) / a) - math.log((other + 0.5) / c)
            if value > 1:
                out[term] = value
        return out

    crossed = [lexicon((1,)), lexicon((0,))]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Words(Model(w)) for w in crossed]
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE):
                ids = part.column("_id").to_pylist()
                x = [features(part.column("_text"), w) for w in words]
                own = np.where(fold(ids, 2)[:, None] == 0, x[0], x[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), part.column("_y").cast(pa.int64()), pa.array(own.tolist(), pa.list_(pa.float64()))],
                    ["_id", "y", "x"],
                )

    table = rows.mapInArrow(measured, "_id long, y long, x array<double>").toPandas().sort_values(["_id", "y"])
    model = Model(lexicon((0, 1)))
    if not len(table):
        return model
    x, y = np.array(table["x"].tolist()), (table["y"].to_numpy() == 1).astype(float)
    margin, part = np.zeros(len(y)), fold([f"cal{k}" for k in table["_id"]], 3)
    for k in range(3):
        margin[part == k] = fit_trees(x[part != k], y[part != k]).margin(x[part == k])
    model.trees, model.knots = fit_trees(x, y), isotonic(margin, y)
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: str | bool = False) -> DataFrame:
    """(doc_id, score) of every row, or all columns of `docs` and the score under the name `keep` (True: `_score`).

    A null or empty text gets the score of a text without any of the features. Repeated rows are scored each for itself.
    """

    keep = "_score" if keep is True else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        for batch in batches:
            for rows in text_slices(batch, text_column, SLICE):
                x = features(rows.column(text_column), words)
                p = calibrated(model.trees.margin(x), model.knots) if model.trees else np.full(len(x), 0.5)
                if keep:
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(p)], [*rows.schema.names, keep])
                else:
                    yield pa.RecordBatch.from_arrays([rows.column(id_column), pa.array(p)], ["doc_id", "score"])
        del words
        release()

    if keep:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
        return docs.mapInArrow(run, ", ".join([*fields, f"`{keep}` double"]))
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, score double")
