"""Exact searches against brute force: inner products over ball trees, ranked texts over two trees."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from skarn.llm import ball_trees, ranked_search
from skarn.llm._shared import ship
from skarn.llm.best import Best

VECTORS = StructType(
    [
        StructField("vec_id", LongType()),
        StructField("embedding", ArrayType(DoubleType())),
        StructField("score", StringType()),
        StructField("query", LongType()),
        StructField("wave", StringType()),
    ]
)


def vector_frame(spark, rows):
    ship(spark)
    return spark.createDataFrame([(k, v, "x", 7, None) for k, v in rows], VECTORS).repartition(3)


def brute_inner(rows, every=5, k=5):
    usable = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in usable]
    out = []
    for at, (q, x) in enumerate(usable):
        if q is None or q % every:
            continue
        scored = [
            (-sum(a * b for a, b in zip(x, y)), i is None, i if i is not None else 0) for other, (i, y) in enumerate(usable) if other != at and len(x) == len(y)
        ]
        for rank, (score, none, i) in enumerate(sorted(scored)[:k], 1):
            out.append((q, rank, None if none else i, -score))
    return sorted(out, key=str)


def ours_inner(spark, rows, every=5, k=5):
    df = vector_frame(spark, rows)
    return sorted((tuple(r) for r in ball_trees.top_inner_products(df, df.where(f"vec_id % {every} = 0"), k).collect()), key=str)


def vectors(seed, n, dim, scale=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim))
    return [(int(i), (scale * (middle[rng.integers(6)] + 0.2 * rng.normal(size=dim))).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize("scale", [1.0, 3e5, 2.0])
def test_inner_products_equal_brute_force(spark, scale):
    """At the second scale products pass 2^53 and are taken in 64-bit integers."""
    rows = vectors(1, 300, 8, scale)
    rows += [(rows[k][0], rows[k][1]) for k in range(20)]  # rows that repeat
    rows += [(1000 + k, rows[3][1]) for k in range(40)]  # copies under other ids
    rows += [(rows[4][0], rows[5][1])]  # another vector under a known id
    assert ours_inner(spark, rows) == brute_inner(rows)


def test_inner_products_of_odd_rows(spark):
    rows = vectors(2, 30, 4) + [
        (500, None), (505, []), (510, [1.0, None, 0.0, 0.0]), (515, [math.nan] * 4), (520, [math.inf, 0.0, 0.0, 0.0]),
        (525, [0.0] * 4), (None, [2.0] * 4), (None, [2.0] * 4), (530, [1.0, 2.0]), (531, [-1.0, 2.0]), (535, [1.0]),
    ]
    got = ours_inner(spark, rows)
    assert got == brute_inner(rows)
    assert [r for r in got if r[0] == 530] == [(530, 1, 531, 256 * 256 * 3)] and not [r for r in got if r[0] == 535]


def test_inner_products_of_few_or_no_rows_and_blocks(spark, monkeypatch):
    assert ours_inner(spark, [(5, [1.0])]) == [] and ours_inner(spark, []) == [] and ours_inner(spark, [(1, [1.0])]) == []
    rows = vectors(3, 60, 4)
    monkeypatch.setattr(ball_trees, "BLOCK_BYTES", 100)
    assert ours_inner(spark, rows, every=10, k=100) == brute_inner(rows, every=10, k=100)
    with pytest.raises(Exception, match="64 bits"):
        ours_inner(spark, [(5, [1e9]), (10, [1e9])])


@pytest.mark.parametrize("leaf", [1, 3, 64])
@pytest.mark.parametrize("copies", [1, 30])
def test_trees_of_any_depth(monkeypatch, leaf, copies):
    monkeypatch.setattr(ball_trees, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    x = rng.integers(-40, 40, size=(200, 6)).repeat(copies, axis=0)
    x[:50] = 3
    ids = rng.permutation(len(x))
    tree = ball_trees.Tree(ball_trees._tree_row("s", list(x), ids.tolist()))
    q = rng.integers(-40, 40, size=(30, 6))
    best = Best(30, 4, np.full(30, ball_trees.LEAST))
    tree.search(q, best, np.arange(30))
    for k in range(30):
        expected = sorted(zip((-(x @ q[k])).tolist(), ids.tolist()))[:4]
        assert list(zip((-best.score[best.query == k]).tolist(), best.ids[best.query == k].tolist())) == expected
    before = best.floor.copy()
    tree.search(q, best, np.arange(30))  # a second shard of the same rows only fills up with equals
    assert (best.floor >= before).all()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_ranked(docs, items, k=10):
    cut = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    cut = [(i, Counter(t), len(t)) for i, t in cut if t]
    n_docs, total = len(cut), sum(n for _, _, n in cut)
    df = Counter(w for _, c, _ in cut for w in c)
    out = []
    for item, text in items:
        words = set(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for i, c, n in cut:
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if none else i, -score))
    return sorted(out, key=str)


def ours_ranked(spark, docs, items, k=10):
    ship(spark)
    d = spark.createDataFrame([(i, t, "x", 1, "z") for i, t in docs], "doc_id long, text string, n string, at int, wave string").repartition(3)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, query int")
    return sorted((tuple(r) for r in ranked_search.ranked_documents(d, b, k).collect()), key=str)


def texts(seed, n, lengths=(0, 1, 4, 30, 200)):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "cat", "dög", "Ñu", "x1", "42", "naïve", "日本", "a", "b", " ", "é"] + [f"w{k}" for k in range(60)]
    share = np.array([1 / (k + 1) for k in range(len(words))])
    glue = [" ", ", ", "\n", "--", "\t"]
    return ["".join(str(rng.choice(words, p=share / share.sum())) + str(rng.choice(glue)) for _ in range(rng.choice(lengths))) for _ in range(n)]


def test_ranks_equal_brute_force(spark):
    docs = list(enumerate(texts(1, 250)))
    docs += [(None, docs[9][1]), (3, docs[3][1]), (3, docs[8][1]), (900, None), (901, ""), (902, "... !!")]
    docs += [(1000 + k, docs[7][1]) for k in range(30)]
    items = list(enumerate(texts(2, 40, (1, 5, 20)))) + [(5, "the cat"), (None, "dög"), (70, None), (71, ""), (72, "??"), (73, "nowhere")]
    assert ours_ranked(spark, docs, items) == brute_ranked(docs, items)


def test_ranks_in_blocks_and_small_trees(spark, monkeypatch):
    docs, items = list(enumerate(texts(3, 80))), list(enumerate(texts(4, 25, (3, 12))))
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 300)
    monkeypatch.setattr(ranked_search, "TREE_ITEMS", 4)
    monkeypatch.setattr(ranked_search, "TREE_TERMS", 10)
    monkeypatch.setattr(ranked_search, "ITEM_LEAF", 2)
    assert ours_ranked(spark, docs, items, 3) == brute_ranked(docs, items, 3)


def test_ranks_of_empty_tables(spark):
    assert ours_ranked(spark, [], [(1, "a")]) == [] and ours_ranked(spark, [(1, "a")], []) == [] and ours_ranked(spark, [(1, None)], [(1, "a")]) == []


@pytest.mark.parametrize("leaf", [1, 5])
@pytest.mark.parametrize("kind", ["double", "long"])
def test_two_trees_of_any_depth(monkeypatch, leaf, kind):
    monkeypatch.setattr(ranked_search, "DOC_LEAF", leaf)
    monkeypatch.setattr(ranked_search, "ITEM_LEAF", leaf)
    rng = np.random.default_rng(leaf)
    weights = rng.integers(0, 9, 50) * (10**12 if kind == "long" else 1)
    lists = [sorted(rng.choice(50, rng.integers(1, 12), replace=False).tolist()) for _ in range(20)]
    tree = ranked_search.ItemTree(np.arange(20), lists, weights)
    assert tree.kind is (np.int64 if kind == "long" else np.float64)
    dense = rng.integers(0, 1000, (90, 50)) * (rng.random((90, 50)) < 0.2)
    doc, term = np.nonzero(dense)
    ids = rng.permutation(90)
    best = Best(20, 5, np.ones(20))
    ranked_search.DocChunk(ids, np.zeros(90, bool), doc, term, dense[doc, term]).search(tree, best)
    for k, own in enumerate(lists):
        scored = sorted((-int(dense[d, own] @ weights[own]), int(ids[d])) for d in range(90) if dense[d, own] @ weights[own] > 0)[:5]
        assert list(zip((-best.score[best.query == k]).tolist(), best.ids[best.query == k].tolist())) == scored


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = " ".join(texts(5, 20)).encode() + b"tail" * 40
    whole = ranked_search.terms(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(ranked_search, "SLICE", size)
        assert ranked_search.terms(text) == whole
