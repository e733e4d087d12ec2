"""Token tables, rule-based polarity, tags and name spans.

The polarity job follows the published rule set of Hutto & Gilbert, "VADER: A Parsimonious
Rule-based Model for Sentiment Analysis of Social Media Text" (ICWSM 2014). The lexicon is a
table supplied by the caller with one row per lower-case token.

Plan: everything happens inside the row of a text. The lexicon is a constant of the plan, an
array of buckets by hash of the token, so a word is looked up at once; the words with a valence
take their neighbours along, the rules change their valences one after the other, and a fold sums
them up. Nothing is exploded, joined or shuffled, and it runs on a stream as it does on a table.

A lexicon above `ROW_TOKENS` tokens stays a table. A Bloom filter of its tokens then is the
constant; only words that pass it leave the row, are joined to the lexicon, and come back to
their text by one aggregate.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.text import count_of, is_upper, sentiment_words, tokenize
from skarn.operators.filters import likely_in
from skarn.operators.joins import join_groups

# Words and weights of the published method.
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't", "can't",
    "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt",
    "neither", "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't", "neednt", "needn't",
    "never", "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh",
    "wasnt", "werent", "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't", "without", "wont",
    "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
)
BOOST = 0.293
BOOSTERS_UP = (
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "effing",
    "enormously", "entirely", "especially", "exceptionally", "extremely", "fabulously", "flipping", "flippin",
    "fricking", "frickin", "frigging", "friggin", "fully", "fucking", "greatly", "hella", "highly", "hugely",
    "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely", "quite", "really",
    "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "uber", "unbelievably",
    "unusually", "utterly", "very",
)
BOOSTERS_DOWN = (
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginally", "occasionally",
    "partly", "scarcely", "slightly", "somewhat", "sorta", "sortof", "sort-of",
)
BOOSTER_PHRASES = ("just enough", "kind of", "sort of")
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "cut the mustard": 2.0,
    "kiss of death": -1.5, "hand to mouth": -2.0,
}


def _default_boosters() -> dict[str, float]:
    return {**dict.fromkeys(BOOSTERS_UP, BOOST), **dict.fromkeys(BOOSTERS_DOWN, -BOOST)}


@dataclass(frozen=True)
class PolarityRules:
    """Parameters of the context rules. Each rule has a switch."""

    capitals: bool = True
    boosters: bool = True
    negation: bool = True
    idioms: bool = True
    least: bool = True
    contrast: bool = True
    emphasis: bool = True

    booster_words: Mapping[str, float] = field(default_factory=_default_boosters)
    booster_phrases: Sequence[str] = BOOSTER_PHRASES
    phrase_weight: float = -BOOST
    negation_words: Sequence[str] = NEGATIONS
    idiom_values: Mapping[str, float] = field(default_factory=lambda: dict(IDIOMS))
    never_word: str = "never"
    never_followers: Sequence[str] = ("so", "this")
    least_word: str = "least"
    least_exempt: Sequence[str] = ("at", "very")
    contrast_word: str = "but"

    capital_weight: float = 0.733
    distance_factors: Sequence[float] = (1.0, 0.95, 0.9)
    negation_factor: float = -0.74
    never_factors: Sequence[float] = (1.5, 1.25)
    contrast_factors: Sequence[float] = (0.5, 1.5)
    exclamation_weight: float = 0.292
    exclamation_most: int = 4
    question_weight: float = 0.18
    question_most: float = 0.96
    alpha: float = 15.0


ROW_TOKENS = 50_000  # tokens of a lexicon that becomes a constant of the plan, some 2 MB
FILTER_BITS = 1 << 23  # of the Bloom filter of a larger one: 1 MB; fuller filters only let more words through
ROW = "_row"  # tells apart rows that repeat an id

CORE = PolarityRules(
    capitals=False, boosters=False, negation=False, idioms=False, least=False, contrast=False, emphasis=False
)


def token_table(df: DataFrame, id_col: str = "Id", text_col: str = "Text") -> DataFrame:
    """(id, pos, token), pos from 0. Texts without tokens have no rows."""
    return df.select(id_col, F.posexplode(tokenize(F.col(text_col))).alias("pos", "token"))


def first_tokens(df: DataFrame, n: int = 10, id_col: str = "Id", text_col: str = "Text") -> DataFrame:
    """(id, n_tokens, head): length of the token list and its first n entries."""
    tokens = df.select(id_col, tokenize(F.col(text_col)).alias("tokens"))
    return tokens.select(id_col, F.size("tokens").alias("n_tokens"), F.slice("tokens", 1, n).alias("head"))


def lexicon_hits(df: DataFrame, lexicon: DataFrame, id_col: str = "Id", text_col: str = "Text") -> DataFrame:
    """(id, pos, token, valence) of every word found in the lexicon; no other word leaves its row."""
    known = _Lookup.of(lexicon)
    words = F.transform(sentiment_words(F.col(text_col)), F.lower)
    if known is not None:
        found = F.transform(words, lambda w, i: _let(known.valence(w), lambda v: F.when(v.isNotNull(), F.struct(i.alias("pos"), w.alias("token"), v.alias("valence")))))
        return df.select(id_col, F.inline(F.array_compact(found)))
    likely = _likely(lexicon)
    found = F.transform(words, lambda w, i: F.when(likely(w), F.struct(i.alias("pos"), w.alias("token"))))
    hits = df.select(id_col, F.inline(F.array_compact(found)))
    return join_groups(hits, _tokens(lexicon), ["token"]).select(id_col, "pos", "token", "valence")


def polarity(
    df: DataFrame,
    lexicon: DataFrame,
    rules: PolarityRules = PolarityRules(),
    id_col: str = "Id",
    text_col: str = "Text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, *keep, neg, neu, pos, compound) for each text that is neither NULL nor blank.

    Each row is scored for itself, also where an id repeats (see `last_wins` for one row per
    id). `keep` carries columns along. `lexicon` has one row per lower-case token; of a token
    that repeats the largest valence counts, a NULL token or valence does not. `df` may be a
    stream unless the lexicon has more than `ROW_TOKENS` tokens.
    """
    known = _Lookup.of(lexicon)
    texts = df.where(F.col(text_col).rlike(r"\S"))
    if known is None:
        return _polarity_by_join(texts, lexicon, rules, id_col, text_col, keep)
    words = _let(_measures(F.col(text_col), rules), lambda t: _let(_with_valences(t, known), lambda u: _score(t, _hits(t, u), rules)))
    scored = texts.select(id_col, *keep, words.alias("_scores"))
    return scored.select(id_col, *keep, "_scores.*")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _tokens(lexicon: DataFrame) -> DataFrame:
    rows = lexicon.select("token", F.col("valence").cast("double").alias("valence")).where("token is not null and valence is not null")
    return rows.groupBy("token").agg(F.max("valence").alias("valence"))


class _Lookup:
    """A lexicon as a constant: an array of as many small maps as it has tokens, at least."""

    def __init__(self, valences: Mapping[str, float], places: Mapping[str, int], size: int):
        self.size = size
        buckets: list[dict[str, float]] = [{} for _ in range(size)]
        for token, valence in valences.items():
            buckets[places[token]][token] = valence
        # parsed once, when the plan is made: the optimizer folds it
        self.table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,double>>")

    @staticmethod
    def _place(token: Column, size: int) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(size)).cast("int")

    @classmethod
    def of(cls, lexicon: DataFrame) -> _Lookup | None:
        """None where the lexicon is too large; no more rows than the bound reach the driver."""
        size = 1 << (ROW_TOKENS - 1).bit_length()
        rows = lexicon.select("token", F.col("valence").cast("double").alias("valence"), cls._place(F.col("token"), size).alias("at"))
        held = rows.where("token is not null and valence is not null").limit(ROW_TOKENS + 1).collect()
        if len(held) > ROW_TOKENS:
            return None
        fewer = 1 << max(0, len(held) - 1).bit_length()
        valences: dict[str, float] = {}
        for r in held:
            valences[r["token"]] = max(r["valence"], valences.get(r["token"], r["valence"]))
        return cls(valences, {r["token"]: r["at"] % fewer for r in held}, fewer)

    def valence(self, token: Column) -> Column:
        return F.element_at(F.get(self.table, self._place(token, self.size)), token)


def _likely(lexicon: DataFrame) -> Callable[[Column], Column]:
    """A test that every token of the lexicon passes, and few other words."""
    return likely_in(lexicon, "token", FILTER_BITS)


def _measures(text: Column, rules: PolarityRules) -> Column:
    """Words of a text, and what its rules need to know of the text."""

    def more(w: Column) -> Column:
        n_upper = F.size(F.filter(w, is_upper)) if rules.capitals else F.lit(0)
        return F.struct(
            w.alias("words"),
            F.transform(w, F.lower).alias("lower"),
            F.size(w).alias("n_words"),
            ((n_upper > 0) & (n_upper < F.size(w))).alias("mixed"),
            count_of(text, "!").alias("n_bang"),
            count_of(text, "?").alias("n_ask"),
        )

    return _let(sentiment_words(text), more)


def _with_valences(t: Column, known: _Lookup) -> Column:
    return F.transform(t["lower"], known.valence)


def _around(t: Column, i: Column) -> dict[str, Column]:
    """The word at `i` and its neighbours; NULL beyond either end."""
    steps = {"word": 0, "back1": -1, "back2": -2, "back3": -3, "next1": 1, "next2": 2}
    return {name: F.get(t["words"], i + k) for name, k in steps.items()}


def _hits(t: Column, valences: Column) -> Column:
    """(c, v) of each word with a valence: its surroundings, among them which words before it have none, and its valence."""
    places = F.array_compact(F.transform(valences, lambda v, i: F.when(v.isNotNull(), i)))

    def hit(i: Column) -> Column:
        around = _around(t, i)
        free = {f"free{k}": around[f"back{k}"].isNotNull() & F.get(valences, i - k).isNull() for k in (1, 2, 3)}
        context = [c.alias(name) for name, c in {**around, **free, "at": i, "mixed": t["mixed"]}.items()]
        return F.struct(F.struct(*context).alias("c"), F.get(valences, i).alias("v"))

    return F.transform(places, hit)


Step = Callable[[Column, Column], Column]  # (surroundings, valence) -> valence


def _changed(hits: Column, step: Step) -> Column:
    return F.transform(hits, lambda h: F.struct(h["c"].alias("c"), step(h["c"], h["v"]).alias("v")))


def _one_of(word: Column, words: Sequence[str]) -> Column:
    return word.isin(list(words)) if len(words) else F.lit(False)


def _of(word: Column, values: Mapping[str, float]) -> Column:
    """The value of a word; NULL where it has none."""
    if not values:
        return F.lit(None).cast("double")
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in (pair[0], float(pair[1]))]), word)


def _steps(rules: PolarityRules, turn: Column) -> list[Step]:
    """What changes a valence, one after the other, in the published order."""

    def loud(c: Column, name: str) -> Column:
        return is_upper(c[name]) & c["mixed"]

    def capital(v: Column) -> Column:
        return F.when(v > 0, rules.capital_weight).otherwise(-rules.capital_weight)

    def boost(k: int) -> Step:
        def step(c: Column, v: Column) -> Column:
            back = F.lower(c[f"back{k}"])
            weight = F.when(v < 0, -1.0).otherwise(1.0) * F.coalesce(_of(back, rules.booster_words), F.lit(0.0))
            if rules.capitals:
                weight = weight + F.when(loud(c, f"back{k}") & _one_of(back, list(rules.booster_words)), capital(v)).otherwise(0.0)
            return F.when(c[f"free{k}"], v + weight * rules.distance_factors[k - 1]).otherwise(v)

        return step

    def negate(k: int) -> Step:
        def step(c: Column, v: Column) -> Column:
            back = F.lower(c[f"back{k}"])
            denied = _one_of(back, rules.negation_words) | F.contains(back, F.lit("n't"))
            factor = F.when(denied, rules.negation_factor).otherwise(1.0)
            if k == 2:
                never = (c["back2"] == rules.never_word) & _one_of(c["back1"], rules.never_followers)
                factor = F.when(never, rules.never_factors[0]).otherwise(factor)
            if k == 3:
                never = (c["back3"] == rules.never_word) & _one_of(c["back2"], rules.never_followers) | _one_of(c["back1"], rules.never_followers)
                factor = F.when(never, rules.never_factors[1]).otherwise(factor)
            return F.when(c[f"free{k}"], v * factor).otherwise(v)

        return step

    def phrase(c: Column, *names: str) -> Column:
        """NULL where one of the words is missing."""
        parts = [x for name in names for x in (F.lit(" "), c[name])]
        return F.concat(*parts[1:])

    def idiom(c: Column, v: Column) -> Column:
        # A phrase that goes on after the word outranks one that ends at it.
        ranked = [
            ("word", "next1", "next2"), ("word", "next1"), ("back1", "word"), ("back2", "back1", "word"),
            ("back2", "back1"), ("back3", "back2", "back1"), ("back3", "back2"),
        ]
        found = F.coalesce(*[_of(phrase(c, *names), rules.idiom_values) for names in ranked], v)
        damped = F.lit(False)
        for names in (("back3", "back2"), ("back2", "back1")):
            damped = damped | F.coalesce(_one_of(phrase(c, *names), rules.booster_phrases), F.lit(False))
        return F.when(c["free3"], found + F.when(damped, rules.phrase_weight).otherwise(0.0)).otherwise(v)

    def least(c: Column, v: Column) -> Column:
        exempt = F.coalesce(_one_of(F.lower(c["back2"]), rules.least_exempt), F.lit(False))
        return F.when(c["free1"] & (F.lower(c["back1"]) == rules.least_word) & ~exempt, v * rules.negation_factor).otherwise(v)

    def silent(c: Column, v: Column) -> Column:
        word = F.lower(c["word"])
        return F.when(_one_of(word, list(rules.booster_words)) | (word == "kind") & (F.lower(c["next1"]) == "of"), 0.0).otherwise(v)

    def contrast(c: Column, v: Column) -> Column:
        early, late = rules.contrast_factors
        return v * F.when(c["at"] < turn, early).when(c["at"] > turn, late).otherwise(1.0)

    steps: list[Step] = []
    if rules.capitals:
        steps.append(lambda c, v: F.when(loud(c, "word"), v + capital(v)).otherwise(v))
    for k in (1, 2, 3):
        if rules.boosters:
            steps.append(boost(k))
        if rules.negation:
            steps.append(negate(k))
    if rules.idioms:
        steps.append(idiom)
    if rules.least:
        steps.append(least)
    if rules.boosters:
        steps.append(silent)
    if rules.contrast:
        steps.append(contrast)
    return steps


def _score(t: Column, hits: Column, rules: PolarityRules) -> Column:
    """(neg, neu, pos, compound) of a text from its measures and its words with a valence."""

    def adjusted(turn: Column) -> Column:
        found = hits
        for step in _steps(rules, turn):
            found = _changed(found, step)
        return _shares(t, _sums(found), rules)

    if not rules.contrast:
        return adjusted(F.lit(None))
    # NULL where no word turns the text, so that neither side of it is found
    return _let(F.nullif(F.array_position(t["lower"], F.lit(rules.contrast_word)).cast("int"), F.lit(0)) - 1, adjusted)


def _sums(found: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0).alias("n"))

    def add(acc: Column, h: Column) -> Column:
        v = h["v"]
        return F.struct(
            (acc["total"] + v).alias("total"),
            (acc["up"] + F.when(v > 0, v + 1).otherwise(0.0)).alias("up"),
            (acc["down"] + F.when(v < 0, v - 1).otherwise(0.0)).alias("down"),
            (acc["n"] + F.when(v != 0, 1).otherwise(0)).alias("n"),
        )

    return F.aggregate(found, zero, add)


def _shares(t: Column, sums: Column, rules: PolarityRules) -> Column:
    stress = F.lit(0.0)
    if rules.emphasis:
        asked = F.when(t["n_ask"] <= 1, 0.0).when(t["n_ask"] <= 3, t["n_ask"] * rules.question_weight).otherwise(rules.question_most)
        stress = F.least(t["n_bang"], F.lit(rules.exclamation_most)) * rules.exclamation_weight + asked

    def stressed(s: Column) -> Column:
        return F.struct(
            (s["total"] + F.signum(s["total"]) * stress).alias("total"),
            (s["up"] + F.when(s["up"] > -s["down"], stress).otherwise(0.0)).alias("up"),
            (-s["down"] + F.when(s["up"] < -s["down"], stress).otherwise(0.0)).alias("down"),
            (t["n_words"] - s["n"]).alias("flat"),
        )

    def shares(s: Column) -> Column:
        whole = F.nullif(s["up"] + s["down"] + s["flat"], F.lit(0.0))

        def share(part: str) -> Column:
            return F.when(t["n_words"] > 0, F.round(s[part] / whole, 3)).otherwise(0.0)

        return F.struct(
            share("down").alias("neg"),
            share("flat").alias("neu"),
            share("up").alias("pos"),
            F.round(s["total"] / F.sqrt(s["total"] * s["total"] + rules.alpha), 4).alias("compound"),
        )

    return _let(_let(sums, stressed), shares)


def _polarity_by_join(
    texts: DataFrame, lexicon: DataFrame, rules: PolarityRules, id_col: str, text_col: str, keep: Sequence[str]
) -> DataFrame:
    """For a lexicon that stays a table: words likely to be in it leave the row with their surroundings."""
    likely = _likely(lexicon)
    group = [id_col, *keep, ROW]
    rows = texts.withColumn(ROW, F.monotonically_increasing_id()).select(*group, _measures(F.col(text_col), rules).alias("_t"))
    t = F.col("_t")
    places = F.array_compact(F.transform(t["lower"], lambda w, i: F.when(likely(w), i)))

    def candidate(i: Column) -> Column:
        around = [c.alias(name) for name, c in _around(t, i).items()]
        return F.struct(F.get(t["lower"], i).alias("token"), F.struct(*around, i.alias("at"), t["mixed"].alias("mixed")).alias("c"))

    turn = F.nullif(F.array_position(t["lower"], F.lit(rules.contrast_word)).cast("int"), F.lit(0)) - 1
    narrow = [t[c].alias(c) for c in ("n_words", "n_bang", "n_ask")]
    rows = rows.select(*group, F.struct(*narrow, turn.alias("turn")).alias("_n"), F.transform(places, candidate).alias("_likely"))
    out = rows.select(*group, "_n", F.explode_outer("_likely").alias("_w"))
    # A text without such words looks for a token of its own that no lexicon has, not for the same as all others.
    own = F.concat(F.lit(" "), F.col(ROW).cast("string"))
    out = out.select(*group, "_n", F.coalesce("_w.token", own).alias("token"), F.col("_w.c").alias("c"))
    found = join_groups(out, _tokens(lexicon), ["token"], "left")
    back = found.groupBy(*group).agg(
        F.first("_n").alias("_n"),
        F.array_sort(F.collect_list(F.when(F.col("valence").isNotNull(), F.struct(F.col("c.at").alias("at"), "c", F.col("valence").alias("v"))))).alias("_hits"),
    )
    hits = F.col("_hits")

    def placed(h: Column) -> Column:
        def free(k: int) -> Column:
            known = F.exists(hits, lambda o: o["at"] == h["at"] - k)
            return (h["c"][f"back{k}"].isNotNull() & ~known).alias(f"free{k}")

        names = ("word", "back1", "back2", "back3", "next1", "next2", "at", "mixed")
        return F.struct(F.struct(*[h["c"][n].alias(n) for n in names], *[free(k) for k in (1, 2, 3)]).alias("c"), h["v"].alias("v"))

    changed = F.transform(hits, placed)
    for step in _steps(rules, F.col("_n.turn")):
        changed = _changed(changed, step)
    scored = back.select(id_col, *keep, _shares(F.col("_n"), _sums(changed), rules).alias("_scores"))
    return scored.select(id_col, *keep, "_scores.*")


def unigram_tagger(tagged: DataFrame) -> DataFrame:
    """(token, tag): the most frequent tag of each token in a tagged (token, tag) table; ties by name."""
    counts = tagged.groupBy("token", "tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("token").agg(F.min_by("tag", F.struct(-F.col("n"), "tag")).alias("tag"))


def tag_tokens(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add `tag`: from the dictionary, or by the form of the token."""
    token = F.col("token")
    by_form = (
        F.when(token.rlike(r"^[\p{N}.,]+$") & token.rlike(r"\p{N}"), "CD")
        .when(~token.rlike(r"[\p{L}\p{N}]"), "SYM")
        .when(token.rlike(r"^\p{Lu}"), "NNP")
        .when(token.endswith("ing"), "VBG")
        .when(token.endswith("ed"), "VBD")
        .when(token.endswith("ly"), "RB")
        .when(token.endswith("s"), "NNS")
        .otherwise("NN")
    )
    known = dictionary.select(F.col("token").alias("_token"), F.col("tag").alias("_tag"))
    joined = tokens.join(known, F.lower(token) == F.col("_token"), "left")
    return joined.withColumn("tag", F.coalesce("_tag", by_form)).drop("_token", "_tag")


def name_spans(df: DataFrame, id_col: str = "Id", text_col: str = "Text") -> DataFrame:
    """(id, start, end, span, tag): runs of capitalised words that do not open a sentence.

    Only such words leave the row; the runs are then found among the words of one text.
    """
    rows = df.select(id_col, tokenize(F.col(text_col)).alias("token"))
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), "token"), F.lit(1), F.size("token"))
    pairs = rows.select(id_col, F.posexplode(F.arrays_zip("token", before.alias("before"))).alias("pos", "p"))
    capital = F.col("p.token").rlike(r"^\p{Lu}")
    inside = F.col("p.before").isNotNull() & ~F.col("p.before").isin(".", "!", "?")
    candidates = pairs.where(capital & inside).select(id_col, "pos", F.col("p.token").alias("token"))
    order = Window.partitionBy(id_col).orderBy("pos")
    islands = candidates.withColumn("island", F.col("pos") - F.row_number().over(order))
    return islands.groupBy(id_col, "island").agg(
        F.min("pos").alias("start"),
        (F.max("pos") + 1).alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), " ").alias("span"),
        F.lit("NE").alias("tag"),
    ).drop("island")
