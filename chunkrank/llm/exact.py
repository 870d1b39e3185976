"""Exact deduplication by a tree merge of sorted digest runs.

Every partition reduces its texts to a sorted run of digests. Lanes then exchange parts of their
runs in rounds: in round r the lanes that differ only in digit r of their number (base ``fan_in``;
2 gives the binomial exchange) swap entries so that each keeps those whose digest has its digit,
merge the sorted runs they got, and retain one entry per digest. After the last round a digest is
in one lane only. No lane ever holds more than its share, and a text shared by a third of all rows
is one entry per partition from the first step on.

Of equal texts the one with the most code points stays, then the smallest id, then the first row.

Defined cases: null texts count as empty and equal each other; a null id comes after all others;
of rows that repeat id and text exactly one has ``kept``; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkrank.llm.tables import materialised, replayable, row_column

WHITE_SPACE = "\t\n\x0b\x0c\r "
NULL_ID = (1 << 63) - 1

#: Digests that one lane should hold in the end; sets the number of lanes.
LANE_DIGESTS = 2_000_000


def without_white_space(text: F.Column) -> F.Column:
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, place (row number, to tell repeated rows apart), digest, size and code points."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return documents.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.monotonically_increasing_id().alias("place"),
        F.char_length(whole).alias("code_points"),
        without_white_space(whole).alias("bare"),
    ).select(
        "doc_id",
        "place",
        "code_points",
        F.sha2("bare", 256).alias("digest"),
        F.octet_length("bare").alias("size"),
    )


def _entry(doc_id: str, place: str, code_points: str) -> F.Column:
    """Orders the rows of one text: the smallest entry stays."""
    return F.struct(
        (-F.col(code_points)).alias("fewer"),
        F.coalesce(F.col(doc_id), F.lit(NULL_ID)).alias("id_order"),
        F.col(place).alias("place"),
        F.col(doc_id).alias("keep_id"),
    )


def _retain(run: DataFrame) -> DataFrame:
    """Merge equal digests of a lane and check that they stand for texts of one size."""
    merged = run.groupBy("lane", "digest").agg(
        F.min("first").alias("first"),
        F.sum("rows").alias("rows"),
        F.min("size").alias("size"),
        F.max("size").alias("largest"),
    )
    same = F.when(F.col("size") == F.col("largest"), F.col("size")).otherwise(
        F.raise_error(F.lit("two texts of different size have one digest"))
    )
    return merged.select("lane", "digest", "first", "rows", same.alias("size"))


def merged_runs(found: DataFrame, fan_in: int = 8, lanes: int | None = None) -> DataFrame:
    """(digest, first, rows, size): one entry per digest, merged in ceil(log_fan_in(lanes)) rounds."""
    if lanes is None:
        rows = found.count()
        lanes = max(fan_in, math.ceil(rows / LANE_DIGESTS))
    rounds = max(1, math.ceil(math.log(lanes, fan_in) - 1e-9))
    lanes = fan_in**rounds
    # The digest's own number of the lane it ends in; the lane it is in starts with the partition.
    home = F.pmod(F.conv(F.substring("digest", 1, 12), 16, 10).cast("long"), F.lit(lanes))
    run = _retain(
        found.select(
            F.pmod(F.spark_partition_id(), F.lit(lanes)).cast("long").alias("lane"),
            "digest",
            _entry("doc_id", "place", "code_points").alias("first"),
            F.lit(1).cast("long").alias("rows"),
            "size",
        )
    )
    for r in range(rounds):
        place = fan_in**r
        digit = F.pmod(F.floor(F.col("lane") / place), F.lit(fan_in))
        wanted = F.pmod(F.floor(home / place), F.lit(fan_in))
        run = run.withColumn("lane", (F.col("lane") + (wanted - digit) * place).cast("long"))
        run = _retain(run.repartition(lanes, "lane").sortWithinPartitions("lane", "digest"))
    return run.drop("lane")


def marked(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, place."""
    found = digests(replayable(documents), doc_id, text)
    merged = materialised(merged_runs(found, fan_in)).select("digest", "first", F.col("rows").alias("group_size"))
    return found.join(merged, "digest").select(
        "doc_id",
        F.col("first.keep_id").alias("keep_id"),
        "group_size",
        (F.col("place") == F.col("first.place")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def kept_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows that stay, with their own columns."""
    documents = replayable(documents)
    rows = documents.select(row_column(documents).alias("row"), F.monotonically_increasing_id().alias("place"))
    stay = materialised(merged_runs(digests(documents, text=text))).select(F.col("first.place").alias("stays"))
    # Sorted at every size: the rows that stay grow with the table.
    return rows.join(stay.hint("merge"), F.col("place") == F.col("stays"), "left_semi").select("row.*")
