"""Small helpers shared by the operators: reading, passing columns through, shared tables."""

from __future__ import annotations

import contextlib
import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkrank.session import materialised

__all__ = ["map_batches", "materialised", "read", "replayable", "row_column", "vocabulary"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of an installed public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def replayable(df: DataFrame) -> DataFrame:
    """A table whose rows have the same numbers in every pass, for monotonically_increasing_id.

    Files read without a shuffle are such a table as they are; anything else is written once.
    """
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    plan = [x.strip(" +-:*()0123456789") for x in shown.getvalue().splitlines()[1:]]
    if all(re.match(r"$|ColumnarToRow|Project|Filter|FileScan|InputAdapter", x) for x in plan):
        return df
    return materialised(df)


def row_column(df: DataFrame) -> F.Column:
    """The whole row as one struct, so that no working column can clash with its names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str | T.StructType
) -> DataFrame:
    """Apply a function to every Arrow batch; it may drop the batch by returning None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)
