"""The corpus pipeline: five operators of `skarn.llm` one after another over `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a frame; all but the last
return the columns of `documents`. Models are trained on the frame at hand and the labels of the input folder.

toxicity      documents scored 0.7 or more go; clean, null and empty texts stay
language      documents without any letter go (`und`); `lang` takes the predicted language
jaccard       one document of each group of linked documents stays, the one with the smallest doc_id
secrets       every secret in a text, also inside encoded runs, is replaced; `n_chars` follows the text
packing       what is left is packed into sequences: one row per piece with its ids

A null doc_id makes no stage fail: the row is scored and cleaned like others, never counts as a copy, and is packed under
a null id. Repeated rows of an id are judged each for itself, and copies under one id leave one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import jaccard, language, packing, queries, secrets, toxicity
from skarn.llm._shared import ship, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def unused(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7, those with null and empty texts among them, in all their columns."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "_score")
    return toxicity.score(docs, model, keep=score).where(F.col(score) < queries.TOXIC).drop(score)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, `lang` replaced by the predicted language; a table without any known language keeps none."""
    ship(spark)
    lang = unused(docs, "_lang_pred")
    found = language.classify(docs, language.fit(docs, queries.PIECES), keep=lang)
    return found.where(F.col(lang) != "und").withColumn("lang", F.col(lang)).select(docs.columns)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id; texts without words and rows without id stay."""
    ship(spark)
    return jaccard.one_of_each(docs)


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; a null text stays null."""
    ship(spark)
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences; a null text is an empty one."""
    ship(spark)
    return packing.pack_documents(docs, queries.WORD_BPE)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("language", identified),
    ("jaccard", single),
    ("secrets", safe),
    ("packing", packed),
]

# Models, tokenizers and decoded layers are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each stage's table is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
