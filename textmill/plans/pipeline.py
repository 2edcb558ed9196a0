"""Pipelines of steps, and the default one: clean, filter, redact, annotate, chunk, de-duplicate, screen."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.dialect import SPARK, evaluate, prepare
from textmill.operators import adversarial, chunking, clean, dedup, knowledge, metacognition, quality

Step = Callable[..., DataFrame]


class Pipeline:
    """Steps from a DataFrame to a DataFrame, applied in order; a step is a callable or has ``process``."""

    def __init__(self) -> None:
        self.steps: list[tuple[Step, dict]] = []

    def add_step(self, step: object, **kwargs: object) -> Pipeline:
        f = step if callable(step) else step.process
        self.steps.append((f, kwargs))
        return self

    def process(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: d.transform(lambda x: s[0](x, **s[1])), self.steps, df)

    def clear(self) -> None:
        self.steps = []


def annotate(df: DataFrame) -> DataFrame:
    """A struct column metacognition with the numbers of its rules."""
    f = {**metacognition.confidence(SPARK), **{f"complexity_{k}": v for k, v in metacognition.complexity(SPARK).items()}, **{f"load_{k}": v for k, v in metacognition.load(SPARK).items()}, **metacognition.reasoning_types(SPARK)}
    out = evaluate(prepare(df), f)
    return out.withColumn("metacognition", F.struct(*f)).drop(*f, "_t", "_l", "_w", "_p", "_s")


def screen(df: DataFrame) -> DataFrame:
    """Columns requires_review, issues and flags."""
    out = evaluate(adversarial.screen(df), {"flags": adversarial.flags()})
    return out.select(*df.columns, "requires_review", "issues", "flags")


def know(df: DataFrame, recognise: knowledge.Recogniser | None = None) -> DataFrame:
    """A struct column knowledge_graph."""
    graph = knowledge.knowledge_graph(df, recognise)
    graph = graph.select("doc_id", F.struct(*[c for c in graph.columns if c != "doc_id"]).alias("knowledge_graph"))
    return df.join(graph, "doc_id", "left")


def default_pipeline(chunk_size: int = 512, overlap: int = 50, remove_pii: bool = True, quality_threshold: float | None = 0.7, remove_duplicates: bool = True, chunking_strategy: str = "semantic", extract_knowledge: bool = False, add_metacognitive_annotations: bool = False, enable_adversarial_testing: bool = False) -> Pipeline:
    """The default order; each argument turns a step on or off. Rows need doc_id and text."""
    p = Pipeline().add_step(clean.clean_documents)
    if quality_threshold:
        p.add_step(quality.quality_filter, threshold=quality_threshold)
    if remove_pii:
        p.add_step(lambda d: d.withColumn("text", clean.redact(F.col("text"))))
    if add_metacognitive_annotations:
        p.add_step(annotate)
    p.add_step(chunking.chunk, strategy=chunking_strategy, size=chunk_size, overlap=overlap)
    if remove_duplicates:
        p.add_step(drop_repeated_chunks)
    if extract_knowledge:
        p.add_step(know)
    if enable_adversarial_testing:
        p.add_step(screen)
    return p


def drop_repeated_chunks(df: DataFrame) -> DataFrame:
    """Chunks whose text came earlier (by doc_id and place) go; a document without any left stays with none."""
    kept = dedup.dedup_chunks(chunking.explode_chunks(df), ["doc_id", "chunk_ix"])
    left = kept.groupBy(F.col("doc_id").alias("_d")).agg(F.array_sort(F.collect_list("chunk_ix")).alias("_at"))
    out = df.join(left, F.col("doc_id") == F.col("_d"), "left")
    own = F.transform(F.coalesce("_at", F.array().cast("array<int>")), lambda i: F.get("chunks", i))
    return out.withColumn("chunks", own).drop("_d", "_at")
