"""Sinks: JSONL, Parquet, CSV, and a dataset folder for training libraries; and JSONL back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_jsonl(df: DataFrame, path: str, include_metadata: bool = True, compress: bool = False) -> None:
    """One object a row; empty chunks and null fields are left out."""
    out = df if include_metadata else df.drop("metadata")
    if "chunks" in out.columns:
        out = out.withColumn("chunks", F.when(F.size("chunks") > 0, F.col("chunks")))
    w = out.write.option("ignoreNullFields", "true")
    (w.option("compression", "gzip") if compress else w).json(path)


def to_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Snappy; nested columns stay as they are."""
    df.write.option("compression", "snappy").partitionBy(*(partition_by or [])).parquet(path)


def to_csv(df: DataFrame, path: str, columns: list[str] | None = None, most: int = 1000) -> None:
    """With a header; text is cut to ``most`` characters, which is this format's."""
    cols = columns or [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))]
    out = df.select(*cols)
    if "text" in cols:
        out = out.withColumn("text", F.substring("text", 1, most))
    out.write.option("header", "true").option("escape", '"').csv(path)


def to_dataset_folder(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Parquet under data/ and a README.md with the features, as dataset libraries load it; columns id, text, source and metadata where there are such."""
    cols = columns or [c for c in ("id", "doc_id", "text", "source", "metadata") if c in df.columns]
    out = df.select(*cols)
    out.write.option("compression", "snappy").parquet(f"{path.rstrip('/')}/data")
    card = "---\nconfigs:\n- config_name: default\n  data_files: data/*.parquet\n---\n\n" + "\n".join(f"- {c}: {t}" for c, t in out.dtypes) + "\n"
    spark = df.sparkSession
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/README.md")
    stream = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    try:
        stream.write(bytearray(card.encode()))
    finally:
        stream.close()


def from_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Objects, one a line, gzipped or not; with ``schema`` the file is not read to infer one."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(path)
