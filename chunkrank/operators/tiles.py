"""Queries as files of bounded size in the shared folder, read by scoring tasks one at a time.

A tile holds at most so many queries and numbers (or tokens), whatever the skew of the data sets. It is
written once per run, and the chunks as files that are read in batches of bounded size; a task lets the
chunks pass its tile. So neither side is shuffled or broadcast, and a task's memory depends on neither.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkrank.session import shared_dir


@dataclass(frozen=True)
class Tiles:
    """Locations of the files, the table read from them and its rows; of chunks the rows of a batch too."""

    files: tuple[str, ...]
    table: DataFrame
    rows: int = 0
    total: int = 0

    def readable(self) -> bool:
        """Whether the files can be opened outside Spark's readers, as the tasks do."""
        try:
            return all(opened(file) is not None for file in self.files[:1])
        except (OSError, ValueError, NotImplementedError):
            return False


def _place(file: str) -> tuple[pyarrow.fs.FileSystem, str]:
    # Spark writes local paths as file:/a/b.
    return pyarrow.fs.FileSystem.from_uri("file:///" + file[5:].lstrip("/") if file.startswith("file:/") else file)


def opened(file: str) -> pq.ParquetFile:
    system, path = _place(file)
    return pq.ParquetFile(system.open_input_file(path))


def load(file: str, columns: Sequence[str]) -> pa.Table:
    """One tile, with the columns in the order given."""
    return opened(file).read(list(columns)).select(list(columns))


def _may_hold(group: pq.RowGroupMetaData, wanted: set[str | None]) -> bool:
    """Whether the first column of a row group, by its least and largest value, can be one of these."""
    found = group.column(0).statistics
    if None in wanted or found is None or not found.has_min_max or not isinstance(found.min, str):
        return True
    return any(found.min <= value <= found.max for value in wanted)


def batches(file: str, columns: Sequence[str], rows: int, most_bytes: int, wanted: set[str | None] | None = None) -> Iterator[pa.Table]:
    """The rows of a file in batches of ``rows``, small ones together; of data sets (its first column) if named."""
    source = opened(file)
    groups = [i for i in range(source.num_row_groups) if wanted is None or _may_hold(source.metadata.row_group(i), wanted)]
    held, size = [], 0
    for batch in source.iter_batches(batch_size=rows, row_groups=groups, columns=list(columns)):
        held.append(batch)
        size += batch.nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held).select(list(columns))
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).select(list(columns))


def written(
    queries: DataFrame, keys: Sequence[str], elements: Column, rows: int, most_elements: int, parts: int = 1, fewest: int | None = None
) -> Tiles:
    """Write the queries as tiles of at most ``rows`` queries and ``most_elements`` numbers.

    Sorted by key, so that most tiles are of one data set. The largest query sets the number of rows
    that is safe for all. With ``parts`` the tiles are so many where that leaves ``fewest`` rows in each.
    Several tiles are made a fifth smaller than they may be: a range that is a little larger than the
    others would leave a second file of few queries, which all chunks pass as well.
    """
    largest = queries.agg(F.max(elements).alias("most"), F.count(F.lit(1)).alias("count")).first()
    most = max(1, min(rows, most_elements // max(1, largest["most"] or 1)))
    each = most if largest["count"] <= most else max(1, most * 4 // 5)
    if parts > 1:
        each = min(each, max(fewest or 1, math.ceil(largest["count"] / parts)))
    path = shared_dir(queries.sparkSession)
    number = max(1, math.ceil(largest["count"] / each))
    order = [*keys, "query_id"]
    (
        queries.repartitionByRange(number, *order)
        .sortWithinPartitions(*order)
        # Ranges are drawn from a sample; this holds the bound where one is much larger than the others.
        .write.option("maxRecordsPerFile", most)
        .parquet(path)
    )
    table = queries.sparkSession.read.schema(queries.schema).parquet(path)
    return Tiles(tuple(sorted(table.inputFiles())), table, total=largest["count"])


def kept(chunks: DataFrame, elements: Column, rows: int, most_elements: int) -> Tiles:
    """Write the chunks where they are read, in files of at most ``rows``; the largest chunk sets the rows of a batch."""
    path = shared_dir(chunks.sparkSession)
    # Small row groups: a reader holds one at a time.
    chunks.write.option("maxRecordsPerFile", rows).option("parquet.block.size", 16 << 20).parquet(path)
    table = chunks.sparkSession.read.schema(chunks.schema).parquet(path)
    size = table.agg(F.max(elements).alias("most"), F.count(F.lit(1)).alias("count")).first()
    batch = max(1, min(rows, most_elements // max(1, size["most"] or 1)))
    return Tiles(tuple(sorted(table.inputFiles())), table, batch, size["count"])
