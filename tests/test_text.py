import math

import pytest
from pyspark.sql import functions as F

from skarn.functions.text import sentiment_words, tokenize
from skarn.operators import text
from skarn.operators.text import CORE, PolarityRules
from skarn.sources.files import literal_table

WORDS = [("happy", 2.7), ("worst", -3.1), ("good", 1.9), ("bad", -2.5), ("no", -1.2), ("kind", 2.4), ("flat", 0.0)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return literal_table(spark, {"token": "string", "valence": "double"}, WORDS)


@pytest.fixture(scope="module")
def score(spark, lexicon):
    def run(*texts, rules=PolarityRules()):
        df = spark.createDataFrame(list(enumerate(texts)), "Id int, Text string")
        rows = text.polarity(df, lexicon, rules).orderBy("Id").collect()
        return [(r["neg"], r["neu"], r["pos"], r["compound"]) for r in rows]

    return run


def squash(s):
    return pytest.approx(s / math.sqrt(s * s + 15), abs=5.1e-5)


def test_two_plain_sentences(score):
    happy, worst = score("I am so happy!", "This is the worst thing ever.")
    assert happy == (0.0, 0.318, 0.682, 0.6468)
    assert worst == (0.451, 0.549, 0.0, -0.6249)


def test_texts_without_words_score_zero_and_null_and_blank_have_no_row(score):
    assert score("", "   ", "a", None) == [(0.0, 0.0, 0.0, 0.0)]


@pytest.mark.parametrize(
    ("sentence", "total"),
    [
        ("it was good", 1.9),
        ("it was GOOD", 1.9 + 0.733),
        ("IT WAS GOOD", 1.9),
        ("it was very good", 1.9 + 0.293),
        ("it was VERY good", 1.9 + 0.293 + 0.733),
        ("it was hardly good", 1.9 - 0.293),
        ("very nice good", 1.9 + 0.293 * 0.95),
        ("very nice warm good", 1.9 + 0.293 * 0.9),
        ("very nice warm dry good", 1.9),
        ("it was very bad", -2.5 - 0.293),
        ("it was VERY bad", -2.5 - 0.293 - 0.733),
        ("it was not good", 1.9 * -0.74),
        ("it wasn't that good", 1.9 * -0.74),
        ("not at all good", 1.9 * -0.74),
        ("not in the least way good", 1.9),
        ("there is no good", -1.2 + 1.9),
        ("never so good", (1.9 + 0.293) * 1.5),
        ("never this very good", (1.9 + 0.293) * 1.25),
        ("that was a bit of a bad ass", 1.5),
        ("oh what a day good is the bomb", 1.9),
        ("he is only just enough good", 1.9 - 0.293),
        ("he lives hand to mouth bad", -2.0),
        ("what a sort of nice good", 1.9 - 0.293),
        ("hand to mouth bad", -2.0),
        ("to mouth bad", -2.5),
        ("the least good", 1.9 * -0.74),
        ("at least good", 1.9),
        ("kind of good", 1.9),
        ("some kind of good", 1.9 - 0.293),
        ("it is kind and flat", 2.4),
        ("good but bad", 1.9 * 0.5 - 2.5 * 1.5),
        ("good!", 1.9 + 0.292),
        ("good!!!!!!", 1.9 + 4 * 0.292),
        ("bad!", -2.5 - 0.292),
        ("good?", 1.9),
        ("good??", 1.9 + 0.36),
        ("good????", 1.9 + 0.96),
        ("(good), \"good\"", 3.8),
    ],
)
def test_rules(score, sentence, total):
    assert score(sentence)[0][3] == squash(total)


def test_switched_off_rules_only_sum(score):
    assert score("it was NOT VERY good but bad!!!", rules=CORE)[0][3] == squash(1.9 - 2.5)
    only = PolarityRules(capitals=False, boosters=False, idioms=False, least=False, contrast=False, emphasis=False)
    assert score("it was not VERY GOOD!", rules=only)[0][3] == squash(1.9 * -0.74)


def test_shares_add_up(score):
    for neg, neu, pos, compound in score("good bad and no more", "very happy!! worst day", "plain words only"):
        assert neg + neu + pos == pytest.approx(1, abs=0.002) and -1 <= compound <= 1


def test_keep_carries_columns(spark, lexicon):
    df = spark.createDataFrame([(1, "x", "good"), (2, None, "none here")], "Id int, lang string, Text string")
    got = {r["Id"]: r["lang"] for r in text.polarity(df, lexicon, keep=["lang"]).collect()}
    assert got == {1: "x", 2: None}


SENTENCES = [
    "it was GOOD", "it was VERY good but bad!!", "never so good", "he is only just enough good??", "hand to mouth bad", "at least good",
    "kind of good", "some kind of good", "there is no good", "no words here", "", "   ", "a", None, "happy", "good bad good GOOD", "the least good",
]


def test_polarity_stays_in_the_row(spark, lexicon):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "Id int, Text string")
    plan = text.polarity(df, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Exchange", "Generate", "Join", "Aggregate", "Python", "from_json"))
    assert "Exchange" not in text.lexicon_hits(df, lexicon)._jdf.queryExecution().executedPlan().toString()


def test_polarity_on_a_stream(spark, lexicon, tmp_path):
    rows = spark.createDataFrame(list(enumerate(SENTENCES)), "Id int, Text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = (
        text.polarity(stream, lexicon)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "at"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, text.polarity(rows, lexicon).collect()))


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
@pytest.mark.parametrize("bits", [1 << 23, 64])
def test_a_lexicon_that_stays_a_table_gives_the_same(spark, lexicon, monkeypatch, broadcast, bits):
    """Through the Bloom filter, also one so full that it lets words pass that are in no lexicon."""
    rows = spark.createDataFrame([(i % 5, "x", t) for i, t in enumerate(SENTENCES)], "Id int, lang string, Text string")
    expected = sorted(map(tuple, text.polarity(rows, lexicon, keep=["lang"]).collect()))
    hits = sorted(map(tuple, text.lexicon_hits(rows, lexicon).collect()))
    monkeypatch.setattr(text, "ROW_TOKENS", 3)
    monkeypatch.setattr(text, "FILTER_BITS", bits)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df = text.polarity(rows, lexicon, keep=["lang"])
        assert sorted(map(tuple, df.collect())) == expected
        assert sorted(map(tuple, text.lexicon_hits(rows, lexicon).collect())) == hits
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode(_likely" in plan  # likely words only
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_and_missing_lexicon_rows(spark):
    odd = spark.createDataFrame([("good", 1.0), ("good", 1.9), (None, 3.0), ("bad", None)], "token string, valence double")
    df = spark.createDataFrame([(1, "good bad day")], "Id int, Text string")
    assert text.polarity(df, odd, CORE).first()["compound"] == squash(1.9)
    assert [r["valence"] for r in text.lexicon_hits(df, odd).collect()] == [1.9]
    empty = text.polarity(df, odd.limit(0)).first()
    assert (empty["neu"], empty["compound"]) == (1.0, 0.0)


@pytest.mark.parametrize(
    ("sentence", "tokens"),
    [
        ("Good food.", ["Good", "food", "."]),
        ("I don't, can't!", ["I", "do", "n't", ",", "ca", "n't", "!"]),
        ("it's 3.50 or 1,000", ["it", "'s", "3.50", "or", "1,000"]),
        ("well-known café (x)", ["well-known", "café", "(", "x", ")"]),
        ("", []),
    ],
)
def test_tokens(spark, sentence, tokens):
    df = spark.createDataFrame([(sentence,)], "t string")
    assert df.select(tokenize(F.col("t"))).first()[0] == tokens


def test_sentiment_words_keep_emoticons(spark):
    df = spark.createDataFrame([("a Great!!! day :) (ok) b,  x yz",)], "t string")
    assert df.select(sentiment_words(F.col("t"))).first()[0] == ["Great", "day", ":)", "ok", "b,", "yz"]


def test_tags(spark):
    tagged = spark.createDataFrame([("run", "VB"), ("run", "NN"), ("run", "VB"), ("bear", "NN"), ("bear", "VB")], "token string, tag string")
    tokens = spark.createDataFrame([(i, t) for i, t in enumerate(["Run", "bear", "going", "4.5", "!", "Paris", "cats", "quickly", "walked", "sky"])], "pos int, token string")
    got = [r["tag"] for r in text.tag_tokens(tokens, text.unigram_tagger(tagged)).orderBy("pos").collect()]
    assert got == ["VB", "NN", "VBG", "CD", "SYM", "NNP", "NNS", "RB", "VBD", "NN"]


def test_name_spans(spark):
    df = spark.createDataFrame([(1, "We met Anna Maria Berg in Rome. The end. Then Bob left")], "Id int, Text string")
    got = [(r["start"], r["end"], r["span"]) for r in text.name_spans(df).orderBy("start").collect()]
    assert got == [(2, 5, "Anna Maria Berg"), (6, 7, "Rome"), (12, 13, "Bob")]


def test_hits_and_heads(spark, lexicon):
    df = spark.createDataFrame([(1, "Good, bad and GOOD"), (2, "nothing")], "Id int, Text string")
    hits = [tuple(r) for r in text.lexicon_hits(df, lexicon).orderBy("Id", "pos").collect()]
    assert hits == [(1, 0, "good", 1.9), (1, 1, "bad", -2.5), (1, 3, "good", 1.9)]
    heads = [tuple(r) for r in text.first_tokens(df, 2).orderBy("Id").collect()]
    assert heads == [(1, 5, ["Good", ","]), (2, 1, ["nothing"])]
