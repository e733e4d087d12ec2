"""SQL for the review scoring queries."""

from __future__ import annotations

from itertools import combinations

from skarn.plans.oracle.views import _values, with_views
from skarn.plans.reviews import CORPUS_RULES, LEXICON_SCORES, MODEL_SCORES, SCORES, TAGGED


# The token rules written out by hand, apart from the patterns under test: a number with inner marks; words of letters,
# their marks and digits, joined by hyphens; the short forms behind an apostrophe; any other visible character alone.
TOKEN = (
    r"\p{N}+(?:[.,]\p{N}+)+"
    r"|[\p{L}\p{M}\p{N}]+(?:-[\p{L}\p{M}\p{N}]+)*"
    r"|'(?:s|S|m|M|d|D|ll|LL|re|RE|ve|VE)"
    r"|[^\s\p{L}\p{M}\p{N}]"
)
NOT_CONTRACTION = r"(\p{L})([nN]['’][tT])($|[^\p{L}\p{M}\p{N}])"
CHUNK = r"[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]{2,}"
_EDGE_PUNCTUATION = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(_quoted(w) for w in words) + ")"


_WORDS = {
    "chunks": f"SELECT doc_id, regexp_extract_all(text, {_quoted(CHUNK)}) AS l FROM documents",
    "raw": "SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS at_ FROM chunks",
    "words": f"""SELECT doc_id, at_::INTEGER AS at_, CASE WHEN length(b) > 1 THEN b ELSE c END AS word
                 FROM (SELECT *, regexp_replace(c, {_quoted(_EDGE_PUNCTUATION)}, '', 'g') AS b FROM raw)""",
    "hit": "SELECT w.*, valence FROM words w LEFT JOIN v_lexicon ON token = lower(word)",
}


def _final(source: str, emphasis: bool) -> dict[str, str]:
    stress = "0.0::DOUBLE"
    if emphasis:
        stress = """least(length(text) - length(replace(text, '!', '')), 4) * 0.292::DOUBLE +
        CASE WHEN length(text) - length(replace(text, '?', '')) <= 1 THEN 0.0::DOUBLE
             WHEN length(text) - length(replace(text, '?', '')) <= 3
             THEN (length(text) - length(replace(text, '?', ''))) * 0.18::DOUBLE ELSE 0.96::DOUBLE END"""
    return {
        "sums": f"""SELECT doc_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS up,
          -sum(CASE WHEN v < 0 THEN v - 1 ELSE 0 END) AS down, count(*) FILTER (v = 0) AS flat FROM {source} GROUP BY 1""",
        "stressed": f"""SELECT d.doc_id, coalesce(s, 0) + sign(coalesce(s, 0)) * ({stress}) AS s,
          up + CASE WHEN up > down THEN {stress} ELSE 0 END AS up,
          down + CASE WHEN down > up THEN {stress} ELSE 0 END AS down, flat
          FROM documents d LEFT JOIN sums USING (doc_id)""",
        "v_polarity": """SELECT doc_id AS "Id", coalesce(round(down / (up + down + flat), 3), 0.0::DOUBLE) AS neg,
          coalesce(round(flat / (up + down + flat), 3), 0.0::DOUBLE) AS neu,
          coalesce(round(up / (up + down + flat), 3), 0.0::DOUBLE) AS pos,
          round(s / sqrt(s * s + 15.0::DOUBLE), 4) AS compound FROM stressed""",
    }


def _rule_steps() -> dict[str, str]:
    r = CORPUS_RULES
    before = "OVER (PARTITION BY doc_id ORDER BY at_)"
    lags = ", ".join(
        f"lag(word, {k}) {before} AS b{k}, lag(valence IS NOT NULL, {k}) {before} AS known{k}" for k in (1, 2, 3)
    )
    steps = {
        "upper_counts": """SELECT doc_id, count(*) FILTER (word = upper(word) AND word <> lower(word)) AS n_up, count(*) AS n,
          min(at_) FILTER (lower(word) = '""" + r.contrast_word + """') AS turn FROM words GROUP BY 1""",
        "ctx": f"""SELECT h.*, {lags}, lead(word) {before} AS nx, lead(word, 2) {before} AS nx2, n_up > 0 AND n_up < n AS mixed, turn
          FROM hit h JOIN upper_counts USING (doc_id)""",
        "s0": f"""SELECT *, CASE WHEN word = upper(word) AND word <> lower(word) AND mixed
          THEN valence + CASE WHEN valence > 0 THEN {r.capital_weight} ELSE -{r.capital_weight} END::DOUBLE ELSE valence END AS v
          FROM ctx""",
    }
    last = "s0"
    for k, factor in zip((1, 2, 3), r.distance_factors):
        weight = "CASE " + " ".join(f"WHEN lower(b{k}) = {_quoted(t)} THEN {w}::DOUBLE" for t, w in r.booster_words.items()) + " ELSE 0.0::DOUBLE END"
        loud = f"b{k} = upper(b{k}) AND b{k} <> lower(b{k}) AND mixed AND lower(b{k}) IN {_in(r.booster_words)}"
        steps[f"b{k}s"] = f"""SELECT * EXCLUDE (v), CASE WHEN NOT known{k} THEN v + {factor}::DOUBLE * (
            (CASE WHEN v < 0 THEN -1 ELSE 1 END) * ({weight}) +
            CASE WHEN {loud} THEN CASE WHEN v > 0 THEN {r.capital_weight}::DOUBLE ELSE -{r.capital_weight}::DOUBLE END ELSE 0 END)
          ELSE v END AS v FROM {last}"""
        negated = f"(lower(b{k}) IN {_in(r.negation_words)} OR contains(lower(b{k}), 'n''t'))"
        never = ""
        so = [f"coalesce(b{j} IN {_in(r.never_followers)}, false)" for j in (1, 2)]
        if k == 2:
            never = f"WHEN b2 = {_quoted(r.never_word)} AND {so[0]} THEN v * {r.never_factors[0]}::DOUBLE"
        if k == 3:
            never = f"WHEN (b3 = {_quoted(r.never_word)} AND {so[1]}) OR {so[0]} THEN v * {r.never_factors[1]}::DOUBLE"
        steps[f"n{k}s"] = f"""SELECT * EXCLUDE (v), CASE WHEN known{k} IS DISTINCT FROM false THEN v {never}
          WHEN {negated} THEN v * {r.negation_factor}::DOUBLE ELSE v END AS v FROM b{k}s"""
        last = f"n{k}s"
    values = ", ".join(f"({_quoted(p)}, {x}::DOUBLE)" for p, x in r.idiom_values.items())
    steps["idiom"] = f"SELECT * FROM (VALUES {values}) AS t(phrase, worth)"
    spoken = ["word || ' ' || nx || ' ' || nx2", "word || ' ' || nx", "b1 || ' ' || word", "b2 || ' ' || b1 || ' ' || word",
              "b2 || ' ' || b1", "b3 || ' ' || b2 || ' ' || b1", "b3 || ' ' || b2"]
    worths = ", ".join(f"(SELECT worth FROM idiom WHERE phrase = {p})" for p in spoken)
    steps["phrased"] = f"""SELECT * EXCLUDE (v), CASE WHEN known3 IS NOT DISTINCT FROM false THEN coalesce({worths}, v) +
        CASE WHEN b3 || ' ' || b2 IN {_in(r.booster_phrases)} OR b2 || ' ' || b1 IN {_in(r.booster_phrases)}
        THEN {r.phrase_weight}::DOUBLE ELSE 0.0::DOUBLE END ELSE v END AS v FROM {last} WHERE valence IS NOT NULL
      UNION ALL BY NAME SELECT * FROM {last} WHERE valence IS NULL"""
    last = "phrased"
    early, late = r.contrast_factors
    steps["adjusted"] = f"""SELECT doc_id, at_, (CASE
        WHEN valence IS NULL OR lower(word) IN {_in(r.booster_words)} OR (lower(word) = 'kind' AND lower(nx) = 'of') THEN 0.0::DOUBLE
        WHEN NOT known1 AND lower(b1) = {_quoted(r.least_word)} AND NOT coalesce(lower(b2) IN {_in(r.least_exempt)}, false)
        THEN v * {r.negation_factor}::DOUBLE ELSE v END) *
        CASE WHEN at_ < turn THEN {early}::DOUBLE WHEN at_ > turn THEN {late}::DOUBLE ELSE 1.0::DOUBLE END AS v FROM {last}"""
    return steps


_CORE = _WORDS | {"plain": "SELECT doc_id, coalesce(valence, 0.0::DOUBLE) AS v FROM hit"} | _final("plain", False)
_RULES = _WORDS | _rule_steps() | _final("adjusted", True)
_JOINT = _RULES | {
    "joint": """SELECT p."Id", p.neg AS lexicon_neg, p.neu AS lexicon_neu, p.pos AS lexicon_pos, p.compound AS lexicon_compound,
      m.neg AS model_neg, m.neu AS model_neu, m.pos AS model_pos, "Score"
      FROM v_polarity p JOIN v_model m USING ("Id") JOIN v_reviews USING ("Id")""",
    "classed": """SELECT *, CASE WHEN lexicon_compound >= 0.05 THEN 'pos' WHEN lexicon_compound <= -0.05 THEN 'neg' ELSE 'neu' END AS lexicon_class,
      CASE greatest(model_neg, model_neu, model_pos) WHEN model_neg THEN 'neg' WHEN model_neu THEN 'neu' ELSE 'pos' END AS model_class,
      CASE "Score" WHEN 1 THEN 'neg' WHEN 3 THEN 'neu' WHEN 5 THEN 'pos' END AS rating_class FROM joint""",
}
_RATED = _RULES | {"rated": 'SELECT * FROM v_polarity JOIN v_reviews USING ("Id")'}

_JOINT_VIEWS = ["v_lexicon", "v_logits", "v_model", "v_reviews"]


def _on(extra: dict[str, str], body: str, views=("v_lexicon", "v_reviews")) -> str:
    return with_views(list(views), body, extra=extra)


def _joint(body: str) -> str:
    return _on(_JOINT, body, _JOINT_VIEWS)


_TOKENS = {
    "tl": f"""SELECT doc_id, regexp_extract_all(regexp_replace(text, {_quoted(NOT_CONTRACTION)}, '\\1 \\2\\3', 'g'),
              {_quoted("[nN]['’][tT]|" + TOKEN)}) AS l FROM documents""",
    "tok": """SELECT doc_id AS "Id", unnest(l) AS token, (generate_subscripts(l, 1) - 1)::INTEGER AS pos FROM tl""",
}
_TAGGER = {
    "tagged": f"SELECT * FROM (VALUES {_values(TAGGED)}) AS t(token, tag)",
    "dict": """SELECT token, tag FROM (SELECT token, tag, row_number() OVER (PARTITION BY token ORDER BY count(*) DESC, tag) AS rn
               FROM tagged GROUP BY 1, 2) WHERE rn = 1""",
}
_PAIRS = list(combinations([*LEXICON_SCORES, *MODEL_SCORES], 2))

SQL = {
    "tokenize_docs": _on(_TOKENS, 'SELECT "Id", pos, token FROM tok', ()),
    "first_tokens": _on(
        _TOKENS, """SELECT doc_id AS "Id", len(l)::INTEGER AS n_tokens, array_to_string(l[1:10], ' ') AS head FROM tl""", ()
    ),
    "lexicon_hits": _on(
        _WORDS, 'SELECT doc_id AS "Id", at_ AS pos, lower(word) AS token, valence FROM hit WHERE valence IS NOT NULL', ("v_lexicon",)
    ),
    "lexicon_polarity": _on(_CORE, "SELECT * FROM v_polarity", ("v_lexicon",)),
    "lexicon_polarity_rules": _on(_RULES, "SELECT * FROM v_polarity", ("v_lexicon",)),
    "sentiment_by_review": _on(_RULES, 'SELECT * FROM v_polarity JOIN v_reviews USING ("Id")'),
    "sentiment_by_rating": _on(
        _RATED,
        f"""SELECT "Score", count(*) AS n, {', '.join(f'round(avg({c}), 6) AS mean_{c}' for c in SCORES)}
        FROM rated WHERE "Score" IS NOT NULL GROUP BY 1""",
    ),
    "rating_ci_normal": _on(
        _RATED,
        """SELECT "Score", variable, count(*) AS n, round(avg(value), 6) AS mean,
        round(avg(value) - 1.96::DOUBLE * stddev_samp(value) / sqrt(count(*)), 6) AS low,
        round(avg(value) + 1.96::DOUBLE * stddev_samp(value) / sqrt(count(*)), 6) AS high
        FROM (UNPIVOT (SELECT "Score", neg, neu, pos, compound FROM rated WHERE "Score" IS NOT NULL)
              ON neg, neu, pos, compound INTO NAME variable VALUE value) GROUP BY 1, 2""",
    ),
    # Poisson replicates of each distinct value, drawn by inversion at the bits of a digest
    "rating_ci_bootstrap": _on(
        _RATED
        | {
            "valued": """SELECT "Score", variable, value AS v, count(*) AS c FROM (
              UNPIVOT (SELECT "Score", neg, neu, pos, compound FROM rated WHERE "Score" IS NOT NULL)
              ON neg, neu, pos, compound INTO NAME variable VALUE value) GROUP BY ALL""",
            "terms": """SELECT DISTINCT c, 0 AS k, exp(-c::DOUBLE) AS term, exp(-c::DOUBLE) AS upto FROM valued
              UNION ALL SELECT c, k + 1, term * c / (k + 1), upto + term * c / (k + 1) FROM terms WHERE term > 1e-18 OR k < c""",
            "steps": "SELECT c, upto, min(k) AS k FROM terms GROUP BY ALL",
            "most": "SELECT c, max(k) AS k FROM terms GROUP BY 1",
            "uniform": """SELECT *, (('0x' || substr(md5(concat_ws(':', "Score"::VARCHAR, variable, v::DECIMAL(30,10)::VARCHAR, b::VARCHAR, '0')),
                1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
              FROM valued, range(1, 1001) r(b)""",
            "drawn": """SELECT u."Score", u.variable, u.v, u.c, u.b, coalesce(s.k, m.k)::DOUBLE AS w FROM uniform u
              ASOF LEFT JOIN steps s ON s.c = u.c AND s.upto >= u.u JOIN most m ON m.c = u.c""",
            "means": """SELECT "Score", variable, b, sum(w * v) / nullif(sum(w), 0) AS m, sum(c * v) AS total, sum(c) AS n
              FROM drawn GROUP BY ALL""",
        },
        """SELECT "Score", variable, max(n)::BIGINT AS n, round(max(total) / max(n), 6) AS mean,
        round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM means GROUP BY 1, 2""",
    ).replace("WITH", "WITH RECURSIVE", 1),
    "score_quantiles_by_rating": _on(
        _RATED,
        "\nUNION ALL\n".join(
            f"""SELECT "Score", {p}::DOUBLE AS prob, round(quantile_cont(compound, {p}), 6) AS quantile, count(*) AS n
            FROM rated WHERE "Score" IS NOT NULL GROUP BY 1"""
            for p in (0.25, 0.5, 0.75)
        ),
    ),
    "score_histogram": _joint(
        f"""SELECT "Score", variable, floor((value + 1) / 0.125)::BIGINT AS bin, count(*) AS n
        FROM (UNPIVOT (SELECT "Score", {', '.join([*LEXICON_SCORES, 'lexicon_compound', *MODEL_SCORES])} FROM joint WHERE "Score" IS NOT NULL)
              ON {', '.join([*LEXICON_SCORES, 'lexicon_compound', *MODEL_SCORES])} INTO NAME variable VALUE value) GROUP BY 1, 2, 3"""
    ),
    "scores_joined": _joint("SELECT * FROM joint"),
    "scorer_confusion": _joint("SELECT lexicon_class, model_class, count(*) AS n FROM classed GROUP BY 1, 2"),
    "scorer_accuracy": _joint(
        "\nUNION ALL\n".join(
            f"""SELECT '{s}' AS scorer, count(*) AS n, count(*) FILTER ({s}_class = rating_class) AS correct,
            round(avg(({s}_class = rating_class)::INTEGER), 6) AS accuracy FROM classed WHERE rating_class IS NOT NULL"""
            for s in ("lexicon", "model")
        )
    ),
    "pairwise_corr_by_rating": _joint(
        "\nUNION ALL\n".join(
            f"""SELECT "Score", count(*) AS n, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r
            FROM joint WHERE "Score" IS NOT NULL GROUP BY 1"""
            for a, b in _PAIRS
        )
    ),
    "pair_bins": _joint(
        "\nUNION ALL\n".join(
            f"""SELECT "Score", '{a}' AS a, '{b}' AS b, floor({a} / 0.125)::BIGINT AS bin_a, floor({b} / 0.125)::BIGINT AS bin_b,
            count(*) AS n FROM joint WHERE "Score" IS NOT NULL GROUP BY ALL"""
            for a, b in _PAIRS
        )
    ),
    "disagreements_per_rating": _joint(
        """SELECT "Score", "Id", round(model_pos - lexicon_pos, 6) AS gap FROM joint WHERE "Score" IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY "Score" ORDER BY round(model_pos - lexicon_pos, 6) DESC, "Id") = 1"""
    ),
    "softmax_scores": _on({}, "SELECT * FROM v_model", ("v_logits", "v_model")),
    "pivot_scores": _on({}, "SELECT * FROM v_model", ("v_logits", "v_model")),
    "model_scores": _on({}, "SELECT *, false AS failed FROM v_model", ("v_logits", "v_model")),
    # naive Bayes from counts of hashed words, smoothed by one; softmax of the summed logarithms
    "text_classifier_scores": r"""
        WITH word AS (
          SELECT doc_id, ('0x' || substr(md5(w), 1, 4))::INTEGER % 16384 AS cell FROM (
            SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents)
        ), rated AS (
          SELECT d.doc_id, CASE WHEN quality + 1 - toxic = 0 THEN 0 WHEN quality + 1 - toxic = 1 THEN 1 ELSE 2 END AS y
          FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL AND toxic IS NOT NULL AND text IS NOT NULL
        ), prior AS (
          SELECT c.y, ln((count(r.y) + 1) / ((SELECT count(*) FROM rated) + 3)) AS p
          FROM (VALUES (0), (1), (2)) c(y) LEFT JOIN rated r ON r.y = c.y GROUP BY c.y
        ), counts AS (SELECT y, cell, count(*) AS n FROM word JOIN rated USING (doc_id) GROUP BY ALL),
        total AS (SELECT c.y, coalesce(sum(n), 0) AS n FROM (VALUES (0), (1), (2)) c(y) LEFT JOIN counts USING (y) GROUP BY c.y),
        shares AS (
          SELECT t.y, c.cell, ln((coalesce(k.n, 0) + 1) / (t.n + 16384)) AS s FROM total t, range(16384) c(cell)
          LEFT JOIN counts k ON k.y = t.y AND k.cell = c.cell
        ), used AS (SELECT doc_id, cell, count(*) AS n FROM word GROUP BY ALL),
        summed AS (SELECT doc_id, y, sum(n * s) AS z FROM used JOIN shares USING (cell) GROUP BY ALL),
        logit AS (
          SELECT d.doc_id, p.y, p.p + coalesce(z, 0) AS z FROM documents d CROSS JOIN prior p
          LEFT JOIN summed u ON u.doc_id = d.doc_id AND u.y = p.y WHERE regexp_matches(d.text, '\S')
        ), top AS (SELECT doc_id, max(z) AS m FROM logit GROUP BY 1),
        share AS (SELECT doc_id, y, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY doc_id) AS p FROM logit JOIN top USING (doc_id))
        SELECT d.doc_id AS "Id", round(max(p) FILTER (y = 0), 6) AS neg, round(max(p) FILTER (y = 1), 6) AS neu, round(max(p) FILTER (y = 2), 6) AS pos
        FROM documents d LEFT JOIN share USING (doc_id) GROUP BY d.doc_id""",
    "scoring_quarantine": """
    SELECT doc_id AS "Id", CASE WHEN text IS NULL THEN 'null text' ELSE 'blank text' END AS reason
    FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '\\S')""",
    "scored_or_quarantined": """
    SELECT doc_id AS "Id", CASE WHEN text IS NULL THEN 'null text' WHEN NOT regexp_matches(text, '\\S') THEN 'blank text'
      ELSE 'scored' END AS outcome FROM documents""",
    "tag_tokens": _on(
        _TOKENS | _TAGGER,
        """SELECT "Id", pos, tok.token, coalesce(dict.tag, CASE
          WHEN regexp_full_match(tok.token, '[\\p{N}.,]+') AND regexp_matches(tok.token, '\\p{N}') THEN 'CD'
          WHEN NOT regexp_matches(tok.token, '[\\p{L}\\p{N}]') THEN 'SYM'
          WHEN regexp_matches(tok.token, '^\\p{Lu}') THEN 'NNP'
          WHEN tok.token LIKE '%ing' THEN 'VBG' WHEN tok.token LIKE '%ed' THEN 'VBD' WHEN tok.token LIKE '%ly' THEN 'RB'
          WHEN tok.token LIKE '%s' THEN 'NNS' ELSE 'NN' END) AS tag
        FROM tok LEFT JOIN dict ON dict.token = lower(tok.token)""",
        (),
    ),
    "entity_spans": _on(
        _TOKENS
        | {
            "cap": """SELECT *, pos - row_number() OVER (PARTITION BY "Id" ORDER BY pos) AS island FROM (
              SELECT *, lag(token) OVER (PARTITION BY "Id" ORDER BY pos) AS prev FROM tok)
              WHERE regexp_matches(token, '^\\p{Lu}') AND prev NOT IN ('.', '!', '?')""",
            "runs": """SELECT "Id", pos, token, island FROM (
              SELECT "Id", pos, token, pos - row_number() OVER (PARTITION BY "Id" ORDER BY pos) AS island FROM cap)""",
        },
        """SELECT "Id", min(pos) AS start, max(pos) + 1 AS "end", string_agg(token, ' ' ORDER BY pos) AS span, 'NE' AS tag
        FROM runs GROUP BY "Id", island""",
        (),
    ),
}
for _rating, _score in ((1, "lexicon_pos"), (1, "model_pos"), (5, "lexicon_neg"), (5, "model_neg")):
    SQL[f"top_disagreement_{_rating}_{_score.split('_')[0]}"] = _joint(
        f"""SELECT "Id", {_score}, "Text" FROM joint JOIN v_reviews USING ("Id") WHERE joint."Score" = {_rating}
        ORDER BY {_score} DESC, "Id" LIMIT 1"""
    )
