"""Where a row stood in its files: numbers in file order, and inside groups, without one big sort.

A scan marks its rows with ``_at`` = (file, block, row). Files count in the order of their paths. Parquet
knows the row's number in its file; of other formats rows are counted inside the block that a task read.
The mark orders rows across files; dense numbers come from one count per file (or block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkrank.session import materialised

AT = "_at"


def marked(scan: DataFrame, fmt: str) -> DataFrame:
    """Add the position mark to a table just read from files."""
    if fmt == "parquet":
        block, row = F.lit(0).cast("long"), F.col("_metadata.row_index")
    else:
        block, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    at = F.struct(F.col("_metadata.file_path").alias("file"), block.alias("block"), row.alias("row"))
    return scan.select("*", at.alias(AT))


def numbered_in_files(rows: DataFrame, name: str) -> DataFrame:
    """Number the rows of a whole scan 0, 1, … in file order; no row is moved.

    Only the marks are read to count each file. One row per file (block) is sent to the tasks. A scan
    that has lost rows since is an error; ``numbered_within`` numbers what is left.
    """
    piece = [F.col(f"{AT}.file").alias("_file"), F.col(f"{AT}.block").alias("_block")]
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    row = F.col(f"{AT}.row")
    whole = F.max(row) - F.min(row) + 1 == F.count(row)
    lost = F.raise_error(F.lit("rows are missing: number them before they are filtered"))
    first = F.when(whole, F.min(row)).otherwise(lost.cast("long")).alias("_first")
    starts = (
        rows.groupBy(*piece)
        .agg(F.count(F.lit(1)).alias("_rows"), first)
        .select("_file", "_block", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    return (
        rows.select("*", *piece)
        .join(F.broadcast(starts), ["_file", "_block"])
        .withColumn(name, F.col(f"{AT}.row") + F.col("_shift"))
        .drop("_file", "_block", "_shift")
    )


def numbered_within(rows: DataFrame, keys: Sequence[str], order: Column, name: str) -> DataFrame:
    """Number the rows of every group 0, 1, … by ``order``, however large a group is.

    Rows are dealt into ranges of (group, order), so a large group has many tasks. Each range numbers
    what it holds of a group; the counts before it, one row per range and group in it, are added.
    """
    placed = (
        rows.withColumn("_order", order)
        .repartitionByRange(*keys, "_order")
        .sortWithinPartitions(*keys, "_order")
        .withColumn("_row", F.monotonically_increasing_id())
    )
    # Written, so that both readers below see one dealing.
    placed = materialised(placed)
    split = F.shiftright("_row", 33).alias("_split")
    before = Window.partitionBy(*keys).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys, split)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
        .select(*keys, "_split", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.select("*", split)
        .join(F.broadcast(starts), [*keys, "_split"])
        .withColumn(name, F.col("_row") - F.col("_first") + F.col("_start"))
        .select(*[c for c in rows.columns if c != name], name)
    )
