"""Toxicity and language models: forward sums against enumeration, trees, calibration, held-out accuracy."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skarn.llm import boosting, language, queries, toxicity
from skarn.llm._shared import ship

SF = "/root/testdata/sf0.01"


def enumerated(word, pieces, logs):
    """Sum over all ways to cut a word, one by one."""
    total = np.zeros(logs.shape[1])
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, last = [], 0
        for k, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(word[last:k])
                last = k
        if all(p in pieces or len(p) == 1 for p in parts):
            total += np.exp(sum(logs[pieces.get(p, -1)] for p in parts))
    return np.log(total)


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    pieces = {p: k for k, p in enumerate(["a", "b", "ab", "ba", "aba", "bb", "abab", "▁a", "▁"])}
    logs = np.log(rng.random((len(pieces) + 1, 3)))
    words = ["▁abab", "▁xab", "b", "ababab", "▁", "xx"]
    got = language.Lattice(words, language.Pieces(pieces)).totals(logs)
    assert np.allclose(got, [enumerated(w, pieces, logs) for w in words])


def test_expected_uses_add_up_to_the_length():
    pieces = {p: k for k, p in enumerate(["a", "b", "ab", "aba"])}
    logs = np.log(np.full((5, 2), 0.2))
    uses = language.Lattice(["abab", "ba"], language.Pieces(pieces)).uses(logs, np.ones((2, 2)))
    assert np.allclose((uses * np.array([[1], [1], [2], [3]])).sum(axis=0), 6)


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    p = np.where((x[:, 0] > 0.6) & (x[:, 1] < 0.5), 0.9, 0.05)
    y = (rng.random(2000) < p).astype(float)
    margin = boosting.fit_trees(x, y).margin(x)
    assert ((margin > 0) == (p > 0.5)).mean() > 0.95
    knots = boosting.isotonic(margin, y)
    assert (np.diff(knots[1]) >= 0).all()
    assert abs(boosting.calibrated(margin, knots).mean() - y.mean()) < 0.03
    assert np.allclose(boosting.fit_trees(x, np.ones(2000)).margin(x), boosting.fit_trees(x, np.ones(2000)).base)


def test_pooling_by_hand():
    x, y = np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1])
    assert np.allclose(boosting.calibrated(x, boosting.isotonic(x, y)), [0, 0.5, 0.5, 1])


def test_features_see_hidden_letters_and_the_second_person():
    model = toxicity.Model({"idiot": 5.0, "scu*": 4.0})
    words = toxicity.Words(model)
    rows = toxicity.features(pa.array(["you are an 1d10t!", "a clean text", None, "", "scumbag far from any of those words you", "ID.IOT", "A*B"]), words)
    assert rows.shape == (7, 15) and np.isfinite(rows).all()
    assert rows[:, 0].tolist() == [1, 0, 0, 0, 1, 1, 0] and rows[0, 6] == 1 and rows[4, 6] == 0 and rows[0, 8] == 1


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_toxic_words_are_learned_and_held_out_labels_are_not_used(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in queries.op7_toxicity(spark, SF).collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in rows.items())
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(truth[k], rows[k]["predicted"]) for k in truth if rows[k]["held_out"]]
    assert sum(t == p for t, p in held) / len(held) > 0.93 and sum(p for t, p in held if not t) <= 2
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) as toxic")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, flipped)).collect()}
    assert again == {k: r["score"] for k, r in rows.items()}


def test_toxicity_of_odd_rows(spark, docs):
    rows = [(1, None, "a"), (2, "", "b"), (None, "idiot " * 30_000, "c"), (3, "x", "d"), (3, "x", "d"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (3, 0), (3, 1), (None, 1), (99, 1)], "doc_id long, toxic int")
    scored = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(scored) == 6 and all(0 <= r["score"] <= 1 for r in scored)
    nothing = toxicity.fit(df.limit(0), labels.limit(0))
    assert {r["score"] for r in toxicity.score(df, nothing).collect()} == {0.5}
    assert toxicity.score(df, nothing, keep=True).columns == [*df.columns, "_score"]


def test_languages_are_told_apart(spark, docs):
    rows = {r["doc_id"]: r for r in queries.op8_language(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [rows[k]["lang_pred"] == v for k, v in truth.items() if rows[k]["held_out"]]
    assert len(rows) == len(truth) and np.mean(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_of_odd_rows(spark, docs):
    train = docs.where("lang in ('en', 'fr')").limit(60)
    model = language.fit(train, queries.PIECES)
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 ... %%%", "c"), (None, "the and of ing", "d"), (4, "漢字", "e"), (5, "the " * 40_000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.classify(df, model).collect()}
    assert [got[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[None][0] == "en" and got[5][0] == "en" and got[4][0] in ("en", "fr")
    none = language.fit(docs.limit(0), queries.PIECES)
    assert {r["lang_pred"] for r in language.classify(df, none).collect()} == {"und"}


def test_signs_that_are_no_letters_make_no_language(spark):
    ship(spark)
    docs = [(k, ["the cat and the dog", "der hund und die katze"][k % 2], ["en", "de"][k % 2]) for k in range(40)]
    odd = [(100, "²", None), (101, "½ ① Ⅷ", None), (102, "a" * 30_000, None), (103, "x" * 200_000 + " der hund", None)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.classify(df, language.fit(df, queries.PIECES)).where("doc_id >= 100").collect()}
    assert found[100] == found[101] == "und" and "und" not in (found[102], found[103])


def test_groups_of_words_are_bounded_by_letters():
    words = ["a"] * 100 + ["b" * 50_000, "c" * 50_000] + ["dd"] * 100_000
    groups = list(language.like_long(words))
    assert sorted(k for g in groups for k in g.tolist()) == list(range(len(words)))
    assert all(len(g) == 1 or len(g) * max(len(words[k]) for k in g) <= language.GROUP for g in groups)


def test_documents_that_repeat_a_labelled_id_count_once(spark):
    ship(spark)
    docs = spark.createDataFrame([(k, f"you {'idiot' if k % 2 else 'friend'} number {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    many = docs.unionByName(docs).unionByName(docs)
    one, three = (sorted(tuple(r) for r in toxicity.score(docs, toxicity.fit(d, labels)).collect()) for d in (docs, many))
    assert one == three
