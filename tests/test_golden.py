"""Scores worked out by hand from their definitions, independent of the formulas that Spark and the oracle share."""

import pytest

from textmill.functions.dialect import SPARK, evaluate, prepare
from textmill.operators import adversarial, metacognition, semantic_quality

A = "The study shows data. However it might rain."
B = "Old people are slow. He and she."


@pytest.fixture(scope="module")
def prepared(spark):
    return prepare(spark.createDataFrame([(1, A), (2, B), (3, ""), (4, None)], "doc_id long, text string"))


def scores(df, formulas):
    return {r["doc_id"]: r for r in evaluate(df, formulas).collect()}


def close(row, want):
    assert {k: round(float(row[k]), 6) for k in want} == {k: round(v, 6) for k, v in want.items()}


def test_semantic_quality(spark):
    rows = semantic_quality.score(spark.createDataFrame([(1, A), (2, ""), (3, None)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in rows.collect()}
    close(got[1], {
        "authority": 1.2 / 3.2, "coherence": 0.8, "complexity": 0.3 * 4.625 / 8 + 0.3 * 4 / 25 + 0.2 + 0.2 * 0.25, "factuality": (1 - 0.3) / 2, "reasoning": 0.6,
        "explanations": 0.0, "examples": 0.0, "lexical_diversity": 1.0, "sentence_length": 4.0, "readability": 0.75875, "overall": 0.5192875, "training_value": 0.325,
    })
    for i in (2, 3):
        close(got[i], {"authority": 0.0, "coherence": 0.5, "complexity": 0.0, "factuality": 0.0, "reasoning": 0.0, "lexical_diversity": 0.0, "sentence_length": 0.0, "readability": 0.0})


@pytest.mark.parametrize("word,n", [("the", 1), ("make", 1), ("table", 1), ("rhythm", 1), ("queue", 1), ("idea", 2), ("analysis", 4), ("xyz", 1)])
def test_syllables(spark, word, n):
    assert spark.sql(f"SELECT {semantic_quality.syllables(SPARK, 'x')} AS n FROM (SELECT '{word}' AS x)").first()["n"] == n


def test_screening(prepared):
    got = scores(prepared, {**adversarial.fairness(SPARK), **adversarial.robustness(SPARK)})
    close(got[1], {"gender_balance": -1.0, "age_balance": -1.0, "inclusive": 0.5, "robustness": (1 + 1 + 0.5 + 1 - (20 - 8 / 3) / 20) / 4})
    close(got[2], {"gender_balance": 0.5, "age_balance": 0.0, "inclusive": 0.5})
    close(got[3], {"inclusive": 0.5})
    f = adversarial.bias(SPARK)
    types = {k: v for k, v in f.items() if k != "bias_score"}
    got = scores(evaluate(prepared, types), {"bias_score": f["bias_score"], **adversarial.severities(SPARK)})
    close(got[2], {"age_bias": 1.0, "gender_bias": 0.0, "bias_score": 1.0})
    assert got[2]["age_bias_severity"] == "high" and got[2]["gender_bias_severity"] is None and float(got[1]["bias_score"]) == 0.0
    got = scores(prepared, adversarial.shares(SPARK))
    close(got[2], {"gender_male": 0.5, "gender_female": 0.5, "gender_non_binary": 0.0, "age_elderly": 1.0})
    assert got[1]["gender_male"] is None


def test_annotations(prepared):
    got = scores(prepared, {**metacognition.confidence(SPARK), **metacognition.complexity(SPARK)})
    close(got[1], {"confidence_score": 0.0, "lexical": 0.4 * 4.625 / 8 + 0.3 + 0.3 / 8, "syntactic": 0.6 * 4 / 25 + 0.4 * 0.5 / 3, "conceptual": 0.0})
    close(got[2], {"confidence_score": 1.0})
    close(got[3], {"confidence_score": 0.5, "lexical": 0.0, "overall": 0.0})
    close(scores(prepared, {"reading": metacognition.reading(SPARK)})[1], {"reading": 0.6 * 4 / 25 + 0.4 * 4.625 / 8})
