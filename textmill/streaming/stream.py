"""The same columns on streams: cleaning and redaction row by row, repeated texts within a watermark, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators import clean


def clean_stream(stream: DataFrame, redact: str | None = "mask") -> DataFrame:
    out = stream.withColumn("text", clean.clean(F.col("text")))
    return out.withColumn("text", clean.redact(F.col("text"), redact)) if redact else out


def dedup_stream(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """A text that came before within the watermark goes."""
    return stream.withWatermark(time, delay).withColumn("_md5", F.md5(F.col("text").cast("binary"))).dropDuplicatesWithinWatermark(["_md5"]).drop("_md5")


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))
