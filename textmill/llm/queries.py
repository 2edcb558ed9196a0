"""Queries of the operators, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import ann, chat, contamination, language, licenses, neardup, packing, tokens, toxicity, warc
from textmill.llm.common import held_out
from textmill.llm.oracle import ORACLE_SQL  # noqa: F401
from textmill.sources.tables import read_table

VOCABULARY = "word_bpe_49k.json"


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read_table(spark, sf_dir, "documents"), neardup.Config(shingle=3, percent=85))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(toxicity.sample(docs, read_table(spark, sf_dir, "labels").filter(~held)))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(ann.usable(read_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), 4, 2)
    model = language.fit(language.sample(docs.filter(~held)))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"), 0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.format_chats(read_table(spark, sf_dir, "conversations"))
    lists = [F.array_join(c, ",").alias(c) for c in ("inserted_before", "inserted_after")]
    return done.select("conv_id", "turn", "role", "new_role", "action", *lists, "rendered")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), VOCABULARY, 2048)


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.mark(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, VOCABULARY, 2048).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_neardup": op1_neardup,
    "op2_toxicity": op2_toxicity,
    "op3_ann": op3_ann,
    "op4_language": op4_language,
    "op5_warc": op5_warc,
    "op6_chat": op6_chat,
    "op7_packing": op7_packing,
    "op8_contamination": op8_contamination,
    "op9_tokens": op9_tokens,
    "op10_licenses": op10_licenses,
}

