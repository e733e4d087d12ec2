import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import plotdata, scoring, text
from skarn.plans.reviews import _load_linear_scorer
from skarn.streaming.reviews import review_stream, scored_stream


def test_model_scores_are_probabilities_and_failures_spare_the_rest(spark):
    def fragile():
        def predict(batch):
            if any("boom" in str(t) for t in batch):
                raise RuntimeError("bad text")
            return np.array([[0.0, 1.0, float(len(str(t)))] for t in batch])

        return predict

    df = spark.createDataFrame([(i, "boom" if i == 3 else "x" * (i + 1)) for i in range(10)], "Id int, Text string").coalesce(1)
    scores = scoring.model_scores(df, fragile, batch_size=4)
    assert [tuple(r) for r in scoring.scoring_failures(scores).collect()] == [(3, "scorer failed")]
    got = {r["Id"]: r for r in scores.collect()}
    assert len(got) == 10
    assert got[3]["failed"] and got[3]["pos"] is None
    for i in set(range(10)) - {3}:
        p = [got[i][c] for c in scoring.CLASSES]
        assert not got[i]["failed"] and min(p) >= 0 and sum(p) == pytest.approx(1)


def test_model_forecast_over_windows(spark):
    def mean_of_window():
        return lambda batch: batch.mean(axis=1, keepdims=True)

    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0, 4.0, 4.0])], "id int, window array<double>")
    got = {r["id"]: r["prediction"] for r in scoring.model_forecast(df, mean_of_window, "window", 3).collect()}
    assert got == {1: 2.0, 2: 4.0}


def test_quarantine_parts_the_rows(spark):
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "fine"), (5, "x" * 11)]
    df = spark.createDataFrame(texts, "Id int, Text string")
    bad = {r["Id"]: r["reason"] for r in scoring.quarantine(df, max_chars=10).collect()}
    assert bad == {1: "null text", 2: "blank text", 3: "blank text", 5: "text too long"}
    assert [r["Id"] for r in scoring.scorable(df, max_chars=10).collect()] == [4]
    assert scoring.scorable(df).count() == 2


def test_scored_and_quarantined_are_apart_and_complete(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "fine"), (5, "boom"), (4, "again")]
    df = spark.createDataFrame(rows, "Id int, Text string").coalesce(1)

    def fragile():
        def predict(batch):
            if any("boom" in str(t) for t in batch):
                raise RuntimeError("bad text")
            return np.zeros((len(batch), 3))

        return predict

    scores = scoring.model_scores(df, fragile)
    bad = {r["Id"] for r in scoring.quarantine(df).collect()}
    assert sorted(r["Id"] for r in scores.where("not failed").collect()) == [4, 4]
    assert sorted(r["Id"] for r in scores.where("failed").collect()) == [1, 2, 3, 5]
    assert bad == {1, 2, 3} and scores.where("failed and pos is not null").count() == 0
    got = scoring.outcomes(df.where("Text <> 'again' or Text is null"), scores.dropDuplicates(["Id"])).collect()
    assert sorted(map(tuple, got)) == [(1, "null text"), (2, "blank text"), (3, "blank text"), (4, "scored"), (5, "scorer failed")]
    lexicon = spark.createDataFrame([("fine", 2.0)], "token string, valence double")
    assert sorted(r["Id"] for r in text.polarity(df, lexicon).collect()) == [4, 4, 5]


def test_classifier_learns_separable_texts(spark):
    words = {1: "awful broken", 3: "average okay", 5: "lovely great"}
    rows = [(i * 3 + j, s, f"{w} thing") for i in range(15) for j, (s, w) in enumerate(words.items())] + [(99, None, "lovely great thing")]
    df = spark.createDataFrame(rows, "Id int, Score int, Text string")
    scores = scoring.classifier_scores(scoring.fit_text_classifier(df, n_features=256), df)
    got = {r["Id"]: r for r in scores.collect()}
    assert len(got) == 46 and got[99]["pos"] > 0.5
    assert all(r["neg"] + r["neu"] + r["pos"] == pytest.approx(1) for r in got.values())


@pytest.fixture(scope="module")
def joint(spark):
    lexicon = spark.createDataFrame(
        [(1, 0.0, 0.5, 0.5, 0.6), (2, 0.9, 0.1, 0.0, -0.8), (3, 0.0, 1.0, 0.0, 0.0), (4, 0.0, 0.5, 0.5, 0.6)],
        "Id int, neg double, neu double, pos double, compound double",
    )
    model = spark.createDataFrame(
        [(1, 0.2, 0.2, 0.6), (2, 0.3, 0.3, 0.4), (3, 0.1, 0.8, 0.1), (4, 0.5, 0.5, 0.0)], "Id int, neg double, neu double, pos double"
    )
    reviews = spark.createDataFrame([(1, 5, "a"), (2, 1, "b"), (3, None, "c"), (4, 5, "d")], "Id int, Score int, Text string")
    return scoring.joint_scores(lexicon, model, reviews)


def test_joint_scores(joint):
    assert joint.columns == [
        "Id", "lexicon_neg", "lexicon_neu", "lexicon_pos", "lexicon_compound", "model_neg", "model_neu", "model_pos", "Score", "Text",
    ]
    assert joint.count() == 4


def test_comparison(joint):
    got = {r["scorer"]: (r["n"], r["correct"]) for r in scoring.accuracy(joint).collect()}
    assert got == {"lexicon": (3, 3), "model": (3, 1)}
    cells = {(r["lexicon_class"], r["model_class"]): r["n"] for r in scoring.confusion(joint).collect()}
    assert cells == {("pos", "pos"): 1, ("neg", "pos"): 1, ("neu", "neu"): 1, ("pos", "neg"): 1}


def test_top_disagreements_break_ties_by_id(joint):
    assert scoring.top_disagreements(joint, 5, "lexicon_pos").first()["Id"] == 1
    assert [r["Id"] for r in scoring.top_disagreements(joint, 5, "model_neg", k=2).collect()] == [4, 1]
    assert {r["Score"]: r["Id"] for r in scoring.top_per_rating(joint, "lexicon_pos").collect()} == {1: 2, 5: 1}


def test_intervals_agree_on_plenty_of_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, round(float(v), 2)) for k in (1, 5) for v in rng.normal(k / 10, 0.3, size=400)]
    df = spark.createDataFrame([*rows, (None, 0.5), (1, None)], "Score int, v double")
    normal = {r["Score"]: r for r in scoring.mean_interval(df, "Score", "v").collect()}
    boot = {r["Score"]: r for r in scoring.bootstrap_interval(df, "Score", "v", replicates=400).collect()}
    assert set(normal) == set(boot) == {1, 5}
    for k in normal:
        assert boot[k]["n"] == normal[k]["n"] == 400
        assert boot[k]["mean"] == pytest.approx(normal[k]["mean"])
        width = normal[k]["high"] - normal[k]["low"]
        assert boot[k]["low"] == pytest.approx(normal[k]["low"], abs=0.25 * width)
        assert boot[k]["high"] == pytest.approx(normal[k]["high"], abs=0.25 * width)
    again = {r["Score"]: r for r in scoring.bootstrap_interval(df, "Score", "v", replicates=400).collect()}
    assert again == boot


@pytest.mark.parametrize("mean", [0.5, 1.0, 7.0, 10.0, 40.0, 499.0, 900.0, 1e7])
def test_poisson_draws(spark, mean):
    draws = spark.range(20_000).select(F.lit(mean).alias("m"), F.xxhash64("id").alias("key"))
    row = draws.select(scoring._poisson("m", "key").alias("k")).agg(F.avg("k"), F.var_samp("k"), F.min("k")).first()
    assert row[0] == pytest.approx(mean, rel=0.03) and row[1] == pytest.approx(mean, rel=0.06) and row[2] >= 0


def test_bins(spark):
    df = spark.createDataFrame([(1, 0.1, 0.9), (1, 0.12, 0.95), (1, 0.6, 0.2), (None, 0.1, 0.1)], "Score int, a double, b double")
    got = {tuple(r) for r in plotdata.pair_bins(df, "Score", ["a", "b"], 0.25).collect()}
    assert got == {(1, "a", "b", 0, 3, 2), (1, "a", "b", 2, 0, 1)}
    hist = {tuple(r) for r in plotdata.histogram(df, "Score", ["a"], 0.0, 0.25).collect()}
    assert hist == {(1, "a", 0, 2), (1, "a", 2, 1)}


def test_row_wise_operators_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5, "this\nthat"), (2, 1, None), (3, 3, "th " * 9)], "Id long, Score int, Text string").write.parquet(str(tmp_path / "in"))
    good, bad = scored_stream(review_stream(spark, str(tmp_path / "in")), _load_linear_scorer)
    for name, stream in (("good_rows", good), ("bad_rows", bad)):
        query = (
            stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
    assert sorted(r["Id"] for r in spark.table("good_rows").collect()) == [1, 3]
    assert [tuple(r) for r in spark.table("bad_rows").collect()] == [(2, "null text")]


def test_count_classifier_equals_naive_bayes_by_hand(spark):
    """Also with rows without rating or text, a class without rows, and texts of no known word."""
    import hashlib
    import math
    import re
    from collections import Counter

    rows = [(1, 5, "Good good DAY"), (2, 5, "fine day"), (3, 1, "bad, bad day"), (4, None, "bad"), (5, 1, None), (6, None, "   "), (7, None, "??"), (8, None, "other")]
    df = spark.createDataFrame(rows, "Id int, Score int, Text string")
    cells = {k: [int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % scoring.FEATURES for w in re.findall(r"[a-z]+", (t or "").lower())] for k, _, t in rows}
    label = {1: 0, 3: 1, 5: 2}
    counts, texts = [Counter(), Counter(), Counter()], [0, 0, 0]
    for k, score, t in rows:
        if score and t:
            counts[label[score]].update(cells[k])
            texts[label[score]] += 1
    model = scoring.fit_count_classifier(df)
    got = {r["Id"]: (r["neg"], r["neu"], r["pos"]) for r in scoring.count_scores(model, df).collect()}
    for k, _, t in rows:
        if not t or not t.strip():
            assert got[k] == (None, None, None)
            continue
        z = [
            math.log((texts[c] + 1) / (sum(texts) + 3))
            + sum(math.log((counts[c][cell] + 1) / (counts[c].total() + scoring.FEATURES)) for cell in cells[k])
            for c in range(3)
        ]
        total = sum(math.exp(v) for v in z)
        assert got[k] == pytest.approx([math.exp(v) / total for v in z])
    assert got[1][2] > 0.5 > got[4][2]
    assert len(scoring.fit_count_classifier(df.limit(0))) == scoring.FEATURES + 1


def test_count_classifier_on_long_texts(spark):
    """Sums of logarithms far beyond what an exponent holds."""
    rows = [(1, 5, "good " * 5000), (2, 1, "bad " * 5000), (3, None, "good " * 3000 + "bad " * 2000)]
    df = spark.createDataFrame(rows, "Id int, Score int, Text string")
    got = {r["Id"]: r for r in scoring.count_scores(scoring.fit_count_classifier(df), df).collect()}
    assert got[1]["pos"] == got[2]["neg"] == got[3]["pos"] == 1.0
