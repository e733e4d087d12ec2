"""Review scoring queries.

Scores are computed from the texts alone and joined to the ratings afterwards, as narrow rows;
a query that shows texts joins them to its few result rows at the end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skarn.functions.numeric import softmax
from skarn.operators import columns, plotdata, profile, scoring, text
from skarn.operators.filters import likely_in
from skarn.operators.joins import natural_left_join
from skarn.sources import views
from skarn.sources.files import literal_table, spread

SCORES = ["neg", "neu", "pos", "compound"]
LEXICON_SCORES = ["lexicon_neg", "lexicon_neu", "lexicon_pos"]
MODEL_SCORES = ["model_neg", "model_neu", "model_pos"]

# Words of the invented corpus in the place of real boosters, negations and so on.
CORPUS_RULES = text.PolarityRules(
    booster_words={"the": 0.293, "is": 0.293, "and": -0.293},
    booster_phrases=("of the", "to the", "and the"),
    negation_words=("of", "not", "des", "no"),
    idiom_values={"with the": 0.7, "the that": -1.2, "of that the": 1.1, "of the": -0.4, "from the of": 2.1},
    never_word="to",
    never_followers=("by", "in"),
    least_word="for",
    least_exempt=("at", "be"),
    contrast_word="are",
)

TAGGED = [
    ("the", "DT"), ("the", "DT"), ("the", "NN"), ("of", "IN"), ("of", "IN"), ("and", "CC"), ("to", "TO"),
    ("to", "TO"), ("to", "IN"), ("is", "VBZ"), ("in", "IN"), ("for", "IN"), ("that", "WDT"), ("that", "IN"),
    ("le", "DT"), ("la", "DT"), ("el", "DT"), ("de", "IN"), ("der", "DT"), ("und", "CC"), (".", "."), (",", ","),
]


def _core(spark, sf_dir):
    return text.polarity(views.scorer_input(spark, sf_dir), views.lexicon(spark), text.CORE)


def _with_rules(spark, sf_dir):
    return text.polarity(views.scorer_input(spark, sf_dir), views.lexicon(spark), CORPUS_RULES)


def _likely_rated(spark, sf_dir, rating=None):
    """Texts that may be rated (so): others are dropped where they are read, before they are cut into words."""
    wanted = likely_in(views.rated_ids(spark, sf_dir, rating), "Id")
    return spread(views.texts(spark, sf_dir).where(wanted(F.col("Id"))), "Id")


def _rated(spark, sf_dir):
    """Scores with ratings, no text; of the texts without a rating only a few."""
    scores = text.polarity(_likely_rated(spark, sf_dir), views.lexicon(spark), CORPUS_RULES)
    return natural_left_join(scores, views.ratings(spark, sf_dir))


def _joint(spark, sf_dir, texts=None):
    """Both scorers and the rating. The texts are read once: model scores ride along."""
    texts = views.scorer_input(spark, sf_dir) if texts is None else texts
    probs = texts.select("Id", "Text", views.model_logits(F.col("Text")).alias("z"))
    probs = probs.select("Id", "Text", softmax(F.col("z")).alias("p"))
    model = probs.select("Id", "Text", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(MODEL_SCORES)])
    scores = text.polarity(model, views.lexicon(spark), CORPUS_RULES, keep=MODEL_SCORES)
    named = columns.prefix_columns(scores, "lexicon_", ["Id", *MODEL_SCORES])
    return natural_left_join(named, views.ratings(spark, sf_dir))


def tokenize_docs(spark, sf_dir):
    return text.token_table(views.scorer_input(spark, sf_dir))


def first_tokens(spark, sf_dir):
    heads = text.first_tokens(views.scorer_input(spark, sf_dir), 10)
    return heads.select("Id", "n_tokens", F.array_join("head", " ").alias("head"))


def lexicon_hits(spark, sf_dir):
    return text.lexicon_hits(views.scorer_input(spark, sf_dir), views.lexicon(spark))


def lexicon_polarity(spark, sf_dir):
    return _core(spark, sf_dir)


def lexicon_polarity_rules(spark, sf_dir):
    return _with_rules(spark, sf_dir)


def sentiment_by_review(spark, sf_dir):
    """Scores merged back onto the whole review rows."""
    return natural_left_join(_with_rules(spark, sf_dir), views.reviews(spark, sf_dir))


def sentiment_by_rating(spark, sf_dir):
    means = columns.mean_by(_rated(spark, sf_dir).where(F.col("Score").isNotNull()), "Score", SCORES)
    return means.withColumns({f"mean_{c}": F.round(f"mean_{c}", 6) for c in SCORES})


def rating_ci_normal(spark, sf_dir):
    out = scoring.mean_intervals(_rated(spark, sf_dir), "Score", SCORES)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


def rating_ci_bootstrap(spark, sf_dir):
    out = scoring.bootstrap_intervals(_rated(spark, sf_dir), "Score", SCORES)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


def score_quantiles_by_rating(spark, sf_dir):
    out = scoring.quantiles_by_rating(_rated(spark, sf_dir), "compound")
    return out.select("Score", "prob", F.round("quantile", 6).alias("quantile"), "n")


def score_histogram(spark, sf_dir):
    measures = [*LEXICON_SCORES, "lexicon_compound", *MODEL_SCORES]
    return plotdata.histogram(_joint(spark, sf_dir), "Score", measures, low=-1.0, width=0.125)


def scores_joined(spark, sf_dir):
    """Two scorers run apart, put side by side and merged with the ratings."""
    return scoring.joint_scores(
        _with_rules(spark, sf_dir), views.model_scores(spark, sf_dir), views.ratings(spark, sf_dir)
    )


def scorer_confusion(spark, sf_dir):
    return scoring.confusion(_joint(spark, sf_dir))


def scorer_accuracy(spark, sf_dir):
    out = scoring.accuracy(_joint(spark, sf_dir, _likely_rated(spark, sf_dir)))
    return out.withColumn("accuracy", F.round("accuracy", 6))


def pairwise_corr_by_rating(spark, sf_dir):
    rated = _joint(spark, sf_dir, _likely_rated(spark, sf_dir)).where(F.col("Score").isNotNull())
    out = profile.correlation_by(rated, "Score", [*LEXICON_SCORES, *MODEL_SCORES])
    return out.withColumn("r", F.round("r", 6))


def pair_bins(spark, sf_dir):
    return plotdata.pair_bins(_joint(spark, sf_dir), "Score", [*LEXICON_SCORES, *MODEL_SCORES], width=0.125)


def _top(rating, score):
    def query(spark, sf_dir):
        joint = _joint(spark, sf_dir, _likely_rated(spark, sf_dir, rating))
        top = scoring.top_disagreements(joint, rating, score).select("Id", score)
        return top.join(views.texts(spark, sf_dir), "Id")

    return query


def disagreements_per_rating(spark, sf_dir):
    joint = _joint(spark, sf_dir, _likely_rated(spark, sf_dir)).withColumn("gap", F.round(F.col("model_pos") - F.col("lexicon_pos"), 6))
    return scoring.top_per_rating(joint, "gap").select("Score", "Id", "gap")


def softmax_scores(spark, sf_dir):
    logits = views.scorer_input(spark, sf_dir).select("Id", views.model_logits(F.col("Text")).alias("z"))
    p = logits.select("Id", softmax(F.col("z")).alias("p"))
    return p.select("Id", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(scoring.CLASSES)])


def pivot_scores(spark, sf_dir):
    """Scores to rows and back to columns."""
    long = columns.to_rows(views.model_scores(spark, sf_dir), ["Id"], scoring.CLASSES)
    return columns.to_columns(long, ["Id"], scoring.CLASSES)


def _load_linear_scorer():
    """Stand-in for trained weights: the same three measures as `views.model_logits`."""

    def predict(batch):
        texts = [str(t) for t in batch]
        size = np.array([len(t) for t in texts], dtype=float)
        first = np.array([len(t.split("\n", 1)[0]) for t in texts], dtype=float)
        th = np.array([t.count("th") for t in texts], dtype=float) * 100 / np.maximum(size, 1)
        chars, line = size / 1000, first / 200
        return np.stack([0.8 * chars - 0.5 * th, 0.6 * line, 0.4 * th - 0.3 * chars], axis=1)

    return predict


def model_scores(spark, sf_dir):
    out = scoring.model_scores(views.scorer_input(spark, sf_dir), _load_linear_scorer)
    return out.select("Id", *[F.round(c, 6).alias(c) for c in scoring.CLASSES], "failed")


def text_classifier_scores(spark, sf_dir):
    """Learnt from counts of the rated texts; every text is scored without a join."""
    model = scoring.fit_count_classifier(views.rated_texts(spark, sf_dir))
    out = scoring.count_scores(model, views.scorer_input(spark, sf_dir))
    return out.select("Id", *[F.round(c, 6).alias(c) for c in scoring.CLASSES])


def scoring_quarantine(spark, sf_dir):
    return scoring.quarantine(views.scorer_input(spark, sf_dir))


def scored_or_quarantined(spark, sf_dir):
    rows = views.scorer_input(spark, sf_dir)
    return scoring.outcomes(rows, scoring.model_scores(rows, _load_linear_scorer))


def tag_tokens(spark, sf_dir):
    tagged = literal_table(spark, {"token": "string", "tag": "string"}, TAGGED)
    return text.tag_tokens(text.token_table(views.scorer_input(spark, sf_dir)), text.unigram_tagger(tagged))


def entity_spans(spark, sf_dir):
    return text.name_spans(views.scorer_input(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_docs,
        first_tokens,
        lexicon_hits,
        lexicon_polarity,
        lexicon_polarity_rules,
        sentiment_by_review,
        sentiment_by_rating,
        rating_ci_normal,
        rating_ci_bootstrap,
        score_quantiles_by_rating,
        score_histogram,
        scores_joined,
        scorer_confusion,
        scorer_accuracy,
        pairwise_corr_by_rating,
        pair_bins,
        disagreements_per_rating,
        softmax_scores,
        pivot_scores,
        model_scores,
        text_classifier_scores,
        scoring_quarantine,
        scored_or_quarantined,
        tag_tokens,
        entity_spans,
    )
}
QUERIES |= {
    f"top_disagreement_{rating}_{scorer}": _top(rating, f"{scorer}_{side}")
    for rating, side in ((1, "pos"), (5, "neg"))
    for scorer in ("lexicon", "model")
}
