"""Arrow batches in slices: what Python makes of texts is held for some rows only, however many a batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 200


def slices(n: int, rows: int = ROWS) -> Iterator[int]:
    """Where slices of a batch of ``n`` rows begin; an empty batch has one."""
    return iter(range(0, max(n, 1), rows))


def map_slices(df: DataFrame, f: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """The frames that ``f`` gives for each slice of ``df``, in columns of ``schema``."""
    to = to_arrow_schema(StructType.fromDDL(schema))

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in slices(batch.num_rows):
                for out in f(batch.slice(at, ROWS).to_pandas(integer_object_nulls=True)):
                    if len(out):
                        yield pa.RecordBatch.from_pandas(out, schema=to, preserve_index=False)

    return df.mapInArrow(of, schema)
