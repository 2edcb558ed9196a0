"""A corpus pipeline of five operators: each stage reads what the one before it wrote.

Toxic documents go, then those whose language cannot be told, then all but the least id of each group of near-duplicates
(five words, a similarity of 0.8), then those that share ten words in a row with the benchmark; the rest is packed into
sequences of 2048 tokens.

Every stage takes and, but for the last, returns all columns of its rows. A null or empty text is not toxic but has no letter, so
it goes with the second stage; repeated rows are one document to the third; rows with a null id stay in it; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import contamination, language, neardup, packing, toxicity
from textmill.llm.common import cut, held_out
from textmill.sources.tables import read_table

VOCABULARY = "word_bpe_49k.json"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5; the classifier learns from labelled rows outside its held-out fold."""
    labels = read_table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 5, 0))
    model = toxicity.fit(toxicity.sample(docs, labels))
    return docs.filter(toxicity.score_of(model)(F.col("text")) < 0.5)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told: those with a letter. Where no row is labelled, nothing is learned and the letter decides alone."""
    model = language.fit(language.sample(docs.filter(~held_out(F.col("doc_id"), 4, 2))))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return docs.filter(language.language_of(model)(F.col("text"))["lang"] != language.UND)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the least id."""
    return neardup.keep_one(docs, neardup.Config(shingle=5, percent=80, match=14))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no span with a benchmark item."""
    return contamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rows and their places in sequences."""
    return packing.pack(docs, VOCABULARY, 2048)


STAGES = [("toxicity", toxic), ("language", identified), ("near_duplicates", distinct), ("decontamination", clean), ("packing", packed)]

#: Scores of trained models and packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
