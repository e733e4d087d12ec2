"""One query per operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import (
    ball_trees,
    byte_bpe,
    huffman,
    jaccard,
    language,
    matroska,
    neighbours,
    packing,
    ranked_search,
    secrets,
    spelling,
    toxicity,
    warc_zip,
)
from skarn.llm._shared import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        AND list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding]) > 0
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
    SELECT vec_id, vec_id AS root FROM embeddings
    UNION
    SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.vec_id
), roots AS (
    SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id
), counts AS (
    SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM roots LEFT JOIN counts USING (vec_id)
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
    ) AS w FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
    END AS g FROM words
), single AS (
    SELECT doc_id, len(g) AS n, unnest(g) AS s FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM single a JOIN single b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS root FROM documents
    UNION
    SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.doc_id
), roots AS (
    SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT sets.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM sets JOIN roots USING (doc_id)
"""


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.payload_digests(matroska.media_of(table(spark, sf_dir, "documents")))


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archived(table(spark, sf_dir, "pages"))


OP5_SQL = """
WITH sized AS (
    SELECT page_id, sha1(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
), last AS (
    SELECT digest, max(page_id) AS response FROM sized WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, n AS payload_bytes, sized.digest AS payload_digest,
    CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN response <> page_id THEN response END AS refers_to
FROM sized LEFT JOIN last ON sized.digest = last.digest AND n >= 1000
"""


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_texts(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_ids(encoded, BYTE_BPE, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("listed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


TOXIC = 0.7  # score from which a text is called toxic


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.classify(docs, language.fit(docs, PIECES)).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def op9_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = huffman.coded_ids(table(spark, sf_dir, "documents"), WORD_BPE)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digested(secrets.scan(table(spark, sf_dir, "documents")))


def op11_ball_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ball_trees.top_inner_products(rows, rows.where(F.col("vec_id") % 50 == 0))


OP11_SQL = """
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
    WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
        FOR i IN range(0, 256)] AS t
), runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS n,
        hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))) AS bytes FROM runs GROUP BY doc_id, run
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295, [CAST(concat('0x', b) AS BIGINT) FOR b IN regexp_extract_all(bytes, '..')]),
        lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) AS h FROM counted, crc
), spoiled AS (
    SELECT CASE WHEN h % 97 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM hashed
), words AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoiled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS MATERIALIZED (
    SELECT word, n, i, concat(left(word, i - 1), substr(word, i + 1)) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION
    SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION
    SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), ranked AS (
    SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
        row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place FROM near
), forms AS MATERIALIZED (
    SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * words.n THEN other END AS form,
        CASE WHEN other_n >= 2 * words.n THEN other_n END AS form_n
    FROM words LEFT JOIN ranked ON words.word = ranked.word AND place = 1
), walked AS (
    SELECT word, word AS root FROM forms
    UNION ALL
    SELECT walked.word, forms.form FROM walked JOIN forms ON walked.root = forms.word WHERE forms.form IS NOT NULL
), ends AS (
    SELECT walked.word, root FROM walked JOIN forms ON root = forms.word WHERE form IS NULL
)
SELECT forms.word, n, n_near, form, form_n, root FROM forms JOIN ends ON forms.word = ends.word
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH cut AS (
    SELECT doc_id, row_number() OVER () AS d, [translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        FOR t IN regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')] AS terms FROM documents
), docs AS MATERIALIZED (
    SELECT d, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM cut WHERE len(terms) > 0
), total AS (
    SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs
), tf AS MATERIALIZED (
    SELECT d, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT d, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY d, doc_id, n, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term
), valued AS (
    SELECT d, doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total.terms))) AS value
    FROM tf JOIN weights ON tf.term = weights.term, total
), items AS (
    SELECT DISTINCT i, item_id, term FROM (
        SELECT i, item_id, unnest([translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            FOR t IN regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')]) AS term
        FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark))
), scored AS (
    SELECT i, item_id, d, doc_id, CAST(sum(value) AS BIGINT) AS score
    FROM items JOIN valued ON items.term = valued.term GROUP BY i, item_id, d, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_packing": op2_packing,
    "op3_jaccard": op3_jaccard,
    "op4_matroska": op4_matroska,
    "op5_warc_zip": op5_warc_zip,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_huffman": op9_huffman,
    "op10_secrets": op10_secrets,
    "op11_ball_trees": op11_ball_trees,
    "op12_spelling": op12_spelling,
    "op13_ranked_search": op13_ranked_search,
}
SQL: dict[str, str] = {
    "op1_neighbours": OP1_SQL,
    "op3_jaccard": OP3_SQL,
    "op5_warc_zip": OP5_SQL,
    "op11_ball_trees": OP11_SQL,
    "op12_spelling": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
