"""Dataset statistics, previews and extraction counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.chunking import words


def summary(df: DataFrame) -> DataFrame:
    """One row: documents, chunks (where there is such a column), characters, and statistics of text length and word count; zeros on an empty table."""
    chunks = [F.size(F.coalesce("chunks", F.array())).alias("k")] if "chunks" in df.columns else []
    x = df.select(F.length(F.coalesce("text", F.lit(""))).alias("c"), F.size(words(F.col("text"))).alias("w"), *chunks)
    out = [F.count("*").alias("total_documents"), *[F.coalesce(F.sum("k"), F.lit(0)).alias("total_chunks") for _ in chunks], F.coalesce(F.sum("c"), F.lit(0)).alias("total_text_length")]
    for c, name in (("c", "text_length"), ("w", "word_count")):
        out += [F.coalesce(f(c).cast("double"), F.lit(0.0)).alias(f"{name}_{k}") for k, f in (("mean", F.mean), ("median", F.median), ("min", F.min), ("max", F.max))]
        out.append(F.coalesce(F.sum(c), F.lit(0)).alias(f"{name}_total"))
    return x.agg(*out)


def score_stats(df: DataFrame, col: str = "quality_score") -> DataFrame:
    """mean, median, min, max and the sample deviation (0 for one row)."""
    return df.agg(F.mean(col).alias("mean"), F.median(col).alias("median"), F.min(col).alias("min"), F.max(col).alias("max"), F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias("stdev"))


def vocabulary(df: DataFrame) -> DataFrame:
    """vocabulary_size and total_words of lower-cased words; words are counted in two steps, so that frequent ones shrink before the shuffle."""
    w = df.select(F.explode(words(F.lower("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return w.agg(F.count("*").alias("vocabulary_size"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"))


def counts_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("documents"))


def preview_metrics(df: DataFrame) -> DataFrame:
    """One row on a preview: average quality, lengths and how many rows are excellent, good, fair and poor."""
    n = F.length(F.coalesce("text", F.lit("")))
    q = F.round(F.least(n / 1000, F.lit(1.0)) * F.when(n < 50, 0.5).otherwise(1.0), 2)
    x = df.select(n.alias("n"), q.alias("q"))
    level = {"excellent": "q >= 0.8", "good": "q >= 0.6 and q < 0.8", "fair": "q >= 0.4 and q < 0.6", "poor": "q < 0.4"}
    return x.agg(F.round(F.avg("q"), 4).alias("avg_quality"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.avg("n").alias("avg_length"), *[F.count_if(F.expr(c)).alias(k) for k, c in level.items()])


def extraction_stats(results: DataFrame) -> DataFrame:
    """One row on an extraction (columns file_size and error): files, bytes, errors and the share of successes in per cent."""
    n, e = F.count("*"), F.count("error")
    return results.agg(n.alias("files_processed"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes_processed"), e.alias("errors"), ((n - e) / F.greatest(n, F.lit(1)) * 100).alias("success_rate"))


def recommendations(metrics: DataFrame, has_labels: bool = False) -> DataFrame:
    """``preview_metrics``'s row with the array recommendations."""
    cases = [
        (F.col("avg_quality") < 0.6, "Quality is low: add documents with more content."),
        (F.col("avg_length") < 100, "Texts are very short: use larger chunks."),
        (F.col("avg_length") > 2000, "Texts are very long: use smaller chunks."),
        (F.lit(not has_labels), "There are no labels: add some for supervised tasks."),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in cases]), lambda x: x.isNotNull())
    return metrics.withColumn("recommendations", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Quality looks good for training."))))


def distribution(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """bucket (number of the last edge at or under the value, from 1; 0 below all) and n, of the values of ``col`` that are not null."""
    bucket = sum((F.when(F.col(col) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return df.filter(F.col(col).isNotNull()).groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def report(df: DataFrame) -> str:
    """An HTML page of a dataset's summary and counts by source and language, where there are such columns."""
    from html import escape

    rows = [(k, v) for k, v in summary(df).first().asDict().items()]
    for col in ("source", "language", "lang"):
        if col in df.columns:
            rows += [(f"{col}: {r[0]}", r[1]) for r in counts_by(df, col).orderBy(F.desc("documents"), col).limit(50).collect()]
    body = "".join(f"<tr><td>{escape(str(k))}</td><td>{escape(str(v))}</td></tr>" for k, v in rows)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Dataset report</title></head><body><h1>Dataset report</h1><table>{body}</table></body></html>"
