"""What the operators share: cut lineage in the shared folder, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.shared import BROADCAST_BYTES, broadcast_checked, cut, own_dir, release, shared_dir  # noqa: F401


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; the quick ``lower`` where the text is ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` by ``mod``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that clash (in any case) with ``names``."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
