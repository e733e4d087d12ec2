"""The Jaccard join against brute force over all pairs."""

import random
import re

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skarn.llm import jaccard
from skarn.llm._shared import ship

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("point", StringType()), StructField("keys", StringType())])


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute(rows):
    """Counter-like list of (doc_id, n, component): rows are nodes, components are named by their smallest id."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]):
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    root[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted(((d, len(sets[k]), None if d is None else least[find(k)]) for k, (d, _) in enumerate(rows)), key=str)


def ours(spark, rows):
    ship(spark)
    df = spark.createDataFrame([(d, t, "other", "columns") for d, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str)


def edited(rng, words, share):
    out = list(words)
    for k in range(len(out)):
        if rng.random() < share:
            out[k] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed, n):
    """Families of edited copies around the threshold, texts made of shared passages, odd texts."""
    rng = random.Random(seed)
    passages = [[f"p{k}w{j}" for j in range(30)] for k in range(4)]
    rows = []
    for family in range(n // 12):
        words = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(6):
            rows.append(" ".join(edited(rng, words, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))))
        for _ in range(6):
            mixed = rng.sample(passages, 3)
            rows.append(" ".join(w for p in mixed for w in p[: rng.randrange(24, 31)]))
    rows += ["", None, " \t\n", "one two", "One  TWO", "one two three four five", "a b c d e f", "É é", rows[0].upper(), rows[0]]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("seed,leaf,pivots", [(1, 1 << 20, 32), (2, 40, 3), (3, 4, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, leaf, pivots):
    """Small leaves and few pivots drive the recursion through several levels."""
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "SHARE", 4)
    rows = corpus(seed, 72)
    assert ours(spark, rows) == brute(rows)


def template_variants(seed, family, n=60, depth=6):
    """Variants that differ from one another at one place each and link sparsely; part of them is missing."""
    rng = random.Random(seed)
    for f in range(family + 1):
        grown = [([f"f{f}w{j}" for j in range(60)], 0)]
        while len(grown) < n:
            own, at = rng.choice(grown[-n // 2 :])
            if at < depth:
                own = [*own]
                own[4 + 6 * rng.randrange(9)] = f"f{f}e{rng.randrange(6)}"
                grown.append((own, at + 1))
        rows = [" ".join(w) for w, _ in grown if rng.random() < 0.7]
    return [*enumerate(rows)]


def test_an_open_point_stays_for_an_unlinked_closed_partner(spark, monkeypatch):
    """The bridge between two groups of variants is a pair of which one side was closed a level before."""
    monkeypatch.setattr(jaccard, "LEAF", 40)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    monkeypatch.setattr(jaccard, "SHARE", 4)
    rows = template_variants(2, 4)
    assert ours(spark, rows) == brute(rows)


def test_repeated_and_missing_ids(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(7, text), (7, text), (None, text), (9, text + " q"), (3, None), (5, "x"), (5, "y")]
    got = ours(spark, rows)
    assert got == brute(rows)


def test_empty_table(spark):
    assert ours(spark, []) == []


def test_one_of_each(spark):
    ship(spark)
    text = "a b c d e f g h i j k l m n o p"
    rows = [(2, text), (1, text + " q"), (4, "other text with its own words here"), (4, "other text with its own words here"), (None, text), (6, None)]
    df = spark.createDataFrame([(d, t, "p", "k") for d, t in rows], SCHEMA)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(df).collect()), key=str)
    assert kept == sorted([(1, text + " q"), (4, rows[2][1]), (None, text), (6, None)], key=str)


def thue_morse(order, a, b):
    word = [a]
    for _ in range(order):
        word += [b if c == a else a for c in word]
    return "".join(word)


def test_words_that_collide_under_polynomials_have_their_own_hashes():
    """For any odd base the sums over these two words are equal modulo 2^64."""
    import pyarrow as pa

    from skarn.llm.shingles import word_hashes

    one, two = thue_morse(10, "a", "b"), thue_morse(10, "b", "a")
    hashes, bounds = word_hashes(pa.array([f"{one} {two}", two, "x", None, "", " abcdefgh abcdefghi Abcdefgh"]))
    assert bounds.tolist() == [0, 2, 3, 4, 4, 4, 7]
    assert hashes[0] != hashes[1] == hashes[2] and hashes[4] == hashes[6] != hashes[5]
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(3000)})
    alone, _ = word_hashes(pa.array(words))
    assert len(set(alone.tolist())) == len(words)
    together, _ = word_hashes(pa.array(["  ".join(words)]))
    assert together.tolist() == alone.tolist()


def test_texts_of_two_words_that_look_alike_to_polynomials(spark):
    rows = [(1, thue_morse(10, "a", "b")), (2, thue_morse(10, "b", "a")), (3, thue_morse(10, "a", "b"))]
    assert ours(spark, rows) == brute(rows) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_parities_never_exclude_a_link():
    """Bounds from parities of any two lengths lie below the true difference."""
    import numpy as np

    from skarn.llm.shingles import apart, parity

    rng = np.random.default_rng(2)
    sets = []
    for n in (0, 1, 5, 200, 300, 700, 5000, 200_000):
        own = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets += [own, np.concatenate([own[: n - n // 9], rng.integers(0, 1 << 63, n // 9).astype(np.uint64)])]
    bits = [np.frombuffer(parity(s), np.uint64) for s in sets]
    for k, s in enumerate(sets):
        bound = apart(bits[k], bits)
        for j, t in enumerate(sets):
            assert bound[j] <= len(np.setxor1d(s, t))
            if k == j:
                assert bound[j] == 0
    assert apart(bits[6], [bits[8]])[0] > (len(sets[6]) + len(sets[8])) / 9  # and they do exclude


def test_texts_that_share_a_passage_are_not_compared(spark, monkeypatch):
    """Sizes, shared keys and parities tell them apart; whole texts move for copies only."""
    seen, real = [], jaccard.distances

    def counted(pairs, texts):
        seen.append(pairs.count())
        return real(pairs, texts)

    monkeypatch.setattr(jaccard, "distances", counted)
    passage = " ".join(f"p{j}" for j in range(40))
    own = [" ".join(f"d{k}w{j}" for j in range(60)) for k in range(14)]
    rows = [(k, f"{passage} {words}" if k % 2 else f"{words} {passage}") for k, words in enumerate(own)]
    rows += [(20, rows[0][1] + " and more"), (21, rows[1][1])]
    assert ours(spark, rows) == brute(rows)
    assert sum(seen) == 1


def test_keys_of_two_sets_are_in_the_filter():
    """Shortened keys that come twice, from one task or two, and no others but a few."""
    import zlib

    import numpy as np

    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 30_000).astype(np.uint64))
    both, alone = keys[:10_000], keys[10_000:]
    sent = {}
    for batch in (jaccard._sent([both[:6000], alone[:9000], both[:3000]]), jaccard._sent([both[3000:], alone[9000:]])):
        for block, packed in jaccard._pieces(iter([batch])):
            sent.setdefault(block, []).append(packed)
    again = jaccard._sent([both[6000:]])
    for block, packed in jaccard._pieces(iter([again])):
        sent.setdefault(block, []).append(packed)
    size = jaccard.FILTER // jaccard.BUCKETS // 8
    bits = np.zeros(jaccard.FILTER // 8, np.uint8)
    for block, pieces in sent.items():
        ((_, packed),) = jaccard._pieces(iter([jaccard._twice(block, pieces)]))
        bits[block * size : (block + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
    assert jaccard._has(bits, both).all()
    assert jaccard._has(bits, alone).mean() < 0.01


def test_texts_that_quote_one_passage_do_not_move(spark, monkeypatch):
    """A region of many texts that sizes and shared keys keep apart asks for no text, however many they are."""
    seen, real = [], jaccard.point_texts

    def counted(docs, id_column, text, wanted):
        seen.append(wanted.count())
        return real(docs, id_column, text, wanted)

    monkeypatch.setattr(jaccard, "point_texts", counted)
    passage = " ".join(f"p{j}" for j in range(60))
    rows = [(k, f"{passage} " + " ".join(f"d{k}w{j}" for j in range(9))) for k in range(30)]
    assert ours(spark, rows) == brute(rows)
    assert seen == [0]


def test_frequent_words_that_meet_by_chance_make_no_key():
    """A sketch as full as that of a large input cannot tell such shingles from others; the counts of their words can."""
    import numpy as np
    import pyarrow as pa

    from skarn.llm.shingles import sets_of_words, shingle_sets, word_hashes

    rng = random.Random(5)
    texts = pa.array([" ".join([f"f{rng.randrange(6)}" for _ in range(60)] + [f"d{k}w{j}" for j in range(60)]) for k in range(200)] + ["f1 f2", "", None])
    words, bounds = word_hashes(texts)
    cells = (words >> np.uint64(64 - jaccard.WORDS)).astype(np.int64)
    weights = (4 * np.log2(np.bincount(cells, minlength=1 << jaccard.WORDS) + 1)).astype(np.uint8)[cells]
    full = np.zeros(1 << jaccard.CELLS, np.uint8)
    sets = [*sets_of_words(words, bounds, 5, weights)]
    assert [s.tolist() for s, _ in sets] == [s.tolist() for s in shingle_sets(texts)]
    keys = [jaccard._rarest(s, w, full) for s, w in sets]
    assert [len(k) for k in keys] == [len(s) - -(-len(s) * 4 // 5) + 1 if len(s) else 0 for s, _ in sets]
    flat = np.concatenate(keys)
    assert len(np.unique(flat)) == len(flat)
    alike = np.concatenate([s[: len(k)] for (s, _), k in zip(sets, keys, strict=True)])  # by hash alone they do meet
    assert len(np.unique(alike)) < len(alike)


@pytest.mark.parametrize("nearest", [16, 2])
def test_points_with_a_partner_are_found(monkeypatch, nearest):
    """Against all pairs, in groups of all points and in those of two sides."""
    import numpy as np

    monkeypatch.setattr(jaccard, "NEAREST", nearest)
    rng = np.random.default_rng(6)
    for _ in range(20):
        group = np.sort(rng.integers(0, 6, 150))
        side = np.where(group < 4, 0, rng.integers(1, 3, 150))
        point, n, degree = rng.integers(0, 120, 150), rng.integers(1, 80, 150), rng.integers(1, 9, 150)
        got = jaccard._partnered(group, side, point, n, degree)
        for k in range(150):
            others = (group == group[k]) & (point != point[k]) & ((side == 0) | (side != side[k]))
            may = [
                9 * abs(int(a) - int(n[k])) <= a + n[k] and 9 * (min(d, degree[k]) + -(-4 * max(a, n[k]) // 5) - 1) >= 4 * (a + n[k])
                for a, d in zip(n[others], degree[others], strict=True)
            ]
            assert got[k] == any(may)
    assert jaccard._partnered(*[np.empty(0, np.int64)] * 5).tolist() == []


def test_regions_dealt_to_several_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SIDE", 3)
    monkeypatch.setattr(jaccard, "NEAREST", 1)
    rows = corpus(4, 72) + [(1000 + k, t) for k, t in template_variants(3, 2)]
    assert ours(spark, rows) == brute(rows)
