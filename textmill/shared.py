"""The folder that driver and executors share: tables that cut lineage are written there, and deleted when nothing reads them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its measured size is at most this many bytes.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and Spark is local."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/textmill/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; a lost executor never recomputes what is before it."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(*dfs: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in dfs:
        if path := getattr(df, "_cut_path", None):
            delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has cut; for its end, when no result is read any more."""
    delete(spark, own_dir(spark))


def broadcast_checked(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the sum of ``row_bytes`` over its rows is at most ``limit``; else unchanged."""
    size = df.select(F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if size <= limit else df
