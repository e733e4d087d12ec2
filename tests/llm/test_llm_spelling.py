"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skarn.llm import spelling
from skarn.llm._shared import ship

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, wide = sorted((a, b), key=len)
    return len(wide) == len(short) + 1 and any(wide[:k] + wide[k + 1 :] == short for k in range(len(wide)))


def brute(docs):
    counts = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    out, form = {}, {}
    for w in n:
        near = sorted((-n[v], v) for v in n if one_edit(w, v))
        form[w] = near[0][1] if near and -near[0][0] >= 2 * n[w] else None
        out[w] = len(near)
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, n[w], out[w], form[w], n.get(form[w]), root))
    return sorted(rows)


def ours(spark, docs):
    ship(spark)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    found = spelling.variants(df).select("word", "n", "n_near", "form", "form_n", "root")
    return sorted(tuple(r) for r in found.collect())


def documents(seed, n=60):
    rng = np.random.default_rng(seed)
    parts = ["an", "na", "tor", "el", "is", "ñó", "é", "th", "ÿ", "×"]
    words = ["".join(rng.choice(parts, rng.integers(2, 5))) for _ in range(60)]
    for w in words[:40]:
        k = int(rng.integers(len(w)))
        words += [w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "o" + w[k + 1 :], w[:k] + "oa" + w[k + 1 :]]
    share = 1 / np.arange(1, len(words) + 1)
    docs = [(int(k), " ".join(rng.choice(words, 80, p=share / share.sum()))) for k in range(n)]
    return [(k, t.upper() if k % 7 == 0 else t.replace(" ", ", ")) for k, t in docs]


@pytest.mark.parametrize("cell", [8192, 8])
def test_variants_equal_brute_force(spark, monkeypatch, cell):
    """With small cells the cut goes deep and cells are dealt into parts."""
    docs = documents(1) + [(3, "canal canals canal Canal"), (3, "canal canals canal Canal"), (None, "tunnel tunnel tunnel tunnl tunnl tunnl tunnl"), (8, None), (9, ""), (10, "日本 12 --")]
    monkeypatch.setattr(spelling, "CELL", cell)
    got = ours(spark, docs)
    assert got == brute(docs) and any(r[3] for r in got) and max(r[2] for r in got) > 3


def test_long_words(spark):
    """Longer than the arrays of letters, with counts above 255, and edits in the middle."""
    long = "ab" * 20 + "c" * 300
    kinds = [long, long + "c", long[:100] + "d" + long[101:], long[:30] + long[31:], long[:200] + "xy" + long[202:], "e" * 90, "e" * 91, "f" + "e" * 90]
    docs = [(k, " ".join([w] * (3 + 4 * i))) for k in range(2) for i, w in enumerate(kinds)]
    got = ours(spark, docs)
    assert got == brute(docs) and sum(r[2] for r in got) > 6


def test_chains_reach_their_root(spark):
    words = ["abcdefghij"[:k] + "z" * (10 - k) for k in range(11)]
    docs = [(1, " ".join(" ".join([w] * (3 << i)) for i, w in enumerate(words)))]
    got = ours(spark, docs)
    assert got == brute(docs) and len({r[5] for r in got}) <= 3


def test_empty_tables_and_factor(spark):
    assert ours(spark, []) == [] and ours(spark, [(1, None)]) == [] and ours(spark, [(1, "once twice")]) == []
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "doc_id long, text string"), factor=1)


def test_tries_find_what_pairs_find():
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.choice(list(b"abcd\xe9"), rng.integers(1, 9)).tolist()) for _ in range(900)})
    all_words = spelling.Words(words, rng.integers(1, 9, len(words)))
    trie = spelling.Trie(all_words)
    found, best = trie.ask(all_words)
    for k, w in enumerate(words):
        near = [j for j, v in enumerate(words) if one_edit(w.decode("latin-1"), v.decode("latin-1"))]
        assert found[k] == len(near)
        if near:
            first = min(near, key=lambda j: (-int(all_words.n[j]), words[j]))
            assert trie.words[best[k]] == words[first]
        for v in words[:: 37]:
            assert spelling.near(w, v) == one_edit(w.decode("latin-1"), v.decode("latin-1"))


def test_texts_are_cut_between_runs(monkeypatch):
    text = documents(2, 1)[0][1] + " end" + "x" * 50
    whole = spelling.runs(text)
    assert whole == Counter(r.translate(LOWER).encode("latin-1") for r in RUN.findall(text))
    for size in (1, 5, 60):
        monkeypatch.setattr(spelling, "SLICE", size)
        assert spelling.runs(text) == whole
    assert spelling.spoiled(1, b"abc", 1) != b"abc" and len(spelling.spoiled(1, "é".encode("latin-1"), 1)) == 0
