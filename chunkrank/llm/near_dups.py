"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

The elements of a text are its 5-word shingles, weighted by how often they occur; similarity is the
weighted Jaccard index. An element of weight w owns the unit regions 0 … w-1 of its weight axis. Into
every region and unit of rank, hashing throws a Poisson(1) number of darts, the same for all
texts. A text takes the darts in its regions up to the rank where about k*ln(k) + 2k darts have
come; every dart falls on one of k coordinates, and the earliest dart on a coordinate is the value
of the signature there. Texts with an empty coordinate go on to twice the rank. Two texts agree on
a coordinate with the probability of their similarity.

Texts with the same words are one node. Nodes that agree on a whole band of coordinates are
candidates; hubs first (see ``components.linked``), then what is still apart, where its bucket is read
(see ``bucket_links``), unless the share of all coordinates that agree is four standard deviations below
the similarity asked for (missing one pair in 30,000 that just reaches it). Candidates are verified on the numbered shingles themselves: the Jaccard index of (shingle, n-th occurrence) is the weighted
index of shingles. They are compared as 32-bit hashes, which adds n*m/2**32 to an intersection.

With 32 bands of 6 a pair of similarity 0.8 is missed with probability 6e-5.

Defined cases: null texts and texts without words are alone; texts of one to four words have one
shingle; equal texts are in one class; of a class the smallest id stays (null ids last, then the
first row); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkrank.llm.bucket_links import crossing
from chunkrank.llm.components import linked
from chunkrank.llm.tables import map_batches, materialised, replayable, row_column
from chunkrank.llm.words import Texts, keyed, mix, slices, windows

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
BAND_WIDTH = 6
#: Coordinates of a signature. The bands take the first ones; all serve to estimate similarity.
COORDINATES = 384
#: Bits kept of each coordinate for the estimate.
PLANES = 4
NULL_ID = (1 << 63) - 1

_POISSON = np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, n + 1))) for n in range(16)])


def _unit(hashes: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (hashes >> np.uint64(11)).astype(np.float64) * 2.0**-53


def cells(texts: Texts, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every unit region (shingle, n-th occurrence), ordered by row."""
    at = texts.whole_windows(shingle)
    hashes = windows(texts.word_hashes, shingle)[at]
    rows = texts.word_row[at]
    sizes = np.diff(texts.first_word)
    short = np.flatnonzero((sizes > 0) & (sizes < shingle))
    if len(short):
        whole = np.array(
            [windows(texts.word_hashes[texts.first_word[r] : texts.first_word[r + 1]], int(sizes[r]))[0] for r in short],
            dtype=np.uint64,
        )
        hashes = np.concatenate([hashes, whole])
        rows = np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    n = np.arange(len(rows))
    begins = np.ones(len(rows), dtype=bool)
    begins[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    occurrence = n - np.maximum.accumulate(np.where(begins, n, 0))
    return rows, keyed(hashes, occurrence)


def signatures(rows: np.ndarray, regions: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """k coordinates for every row; rows without regions keep zeros."""
    weight = np.bincount(rows, minlength=n_rows)
    reach = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    out = np.zeros((n_rows, k), dtype=np.uint64)
    open_rows = weight > 0
    while open_rows.any():
        held = open_rows[rows]
        row, region = rows[held], regions[held]
        slabs = np.ceil(reach[row]).astype(np.int64)
        index = np.repeat(np.arange(len(row)), slabs)
        slab = np.arange(len(index)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
        seed = keyed(region[index], slab)
        darts = np.searchsorted(_POISSON, _unit(mix(seed)), side="right")
        which = np.repeat(np.arange(len(index)), darts)
        number = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = keyed(seed[which], number)
        rank = slab[which] + _unit(dart)
        row = row[index[which]]
        near = rank < reach[row]
        row, rank, dart = row[near], rank[near], dart[near]
        place = row * k + (mix(dart) % np.uint64(k)).astype(np.int64)
        earliest = np.full(n_rows * k, np.inf)
        np.minimum.at(earliest, place, rank)
        first = rank == earliest[place]
        out.reshape(-1)[place[first]] = dart[first]
        empty = np.isinf(earliest).reshape(n_rows, k).any(axis=1)
        open_rows &= empty
        reach[open_rows] *= 2
    return out


def _bands(signature: np.ndarray, bands: int, width: int) -> np.ndarray:
    total = np.zeros((len(signature), bands), dtype=np.uint64)
    by_band = signature.reshape(len(signature), bands, width)
    for j in range(width):
        total = keyed(by_band[:, :, j], 0) + total * np.uint64(0x9E3779B97F4A7C15)
    return keyed(total, np.arange(bands))


def _code(signature: np.ndarray) -> np.ndarray:
    """The lowest bits of every coordinate, plane by plane, 64 coordinates to a number."""
    planes = [
        np.packbits(((signature >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
        for p in range(PLANES)
    ]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def most_differences(similarity: float) -> float:
    """In how many coordinates the codes of texts of this similarity differ, but for four standard deviations."""
    by_chance = 2.0**-PLANES
    share = similarity + (1 - similarity) * by_chance
    return COORDINATES * (1 - share + 4 * float(np.sqrt(share * (1 - share) / COORDINATES)))


def fingerprints(texts: Texts) -> list[np.ndarray]:
    """Two hashes of each row's word sequence."""
    position = np.arange(len(texts.word_row)) - texts.first_word[texts.word_row]
    out = []
    for salt in (1, 2):
        at_place = keyed(keyed(texts.word_hashes, position), salt)
        running = np.zeros(len(at_place) + 1, dtype=np.uint64)
        np.cumsum(at_place, out=running[1:])
        out.append(running[texts.first_word[1:]] - running[texts.first_word[:-1]])
    return out


def sketched(documents: DataFrame, bands: int, width: int, shingle: int) -> DataFrame:
    """doc_id, place, n_words, two fingerprints, band hashes and code of (doc_id, place, text)."""
    names = ("n_words", "print_a", "print_b")
    schema = documents.select("doc_id", "place").schema
    for name in names:
        schema = schema.add(name, T.LongType(), False)
    for name in ("bands", "code"):
        schema = schema.add(name, T.ArrayType(T.LongType(), False), False)

    def lists(parts: list[np.ndarray], rows: int, width: int) -> pa.Array:
        flat = np.concatenate([*[p.reshape(-1) for p in parts], np.zeros(0, np.int64)])
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(flat))

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, prints, found, codes = [], [], [], []
        for texts in slices(batch.column("text")):
            rows, regions = cells(texts, shingle)
            counts.append(np.diff(texts.first_word))
            prints.append(fingerprints(texts))
            signature = signatures(rows, regions, texts.rows, max(COORDINATES, bands * width))
            found.append(_bands(signature[:, : bands * width], bands, width).view(np.int64))
            codes.append(_code(signature[:, :COORDINATES]))
        n = np.concatenate([*counts, np.zeros(0, np.int64)])
        both = [np.concatenate([*[p[i] for p in prints], np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1)]
        arrays = [batch.column("doc_id"), batch.column("place"), pa.array(n), *map(pa.array, both)]
        arrays += [lists(found, len(n), bands), lists(codes, len(n), PLANES * COORDINATES // 64)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "place", *names, "bands", "code"])

    return map_batches(documents, sketch, schema)


def _numbered_shingles(documents: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of (place, text)."""

    def spell(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, found = [], []
        for texts in slices(batch.column("text")):
            rows, regions = cells(texts, shingle)
            sizes.append(np.bincount(rows, minlength=texts.rows))
            found.append((regions >> np.uint64(32)).astype(np.uint32).view(np.int32))
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]))
        flat = pa.array(np.concatenate([*found, np.zeros(0, np.int32)]))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        return pa.RecordBatch.from_arrays([batch.column("place"), lists], names=["node", "shingles"])

    return map_batches(documents, spell, "node long, shingles array<int>")


def classes(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    width: int = BAND_WIDTH,
) -> DataFrame:
    """doc_id, place (row number), class_id (the id that stays), class_size and kept per document."""
    rows = replayable(documents).select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.monotonically_increasing_id().alias("place"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    sketch = materialised(sketched(rows, bands, width, shingle))
    order = F.struct(
        F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("id_order"),
        "place",
        F.col("doc_id").alias("doc_id"),
    )
    prints = ["print_a", "print_b", "n_words"]
    nodes = materialised(
        sketch.filter("n_words > 0")
        .groupBy(*prints)
        .agg(
            F.min(order).alias("first"),
            F.count(F.lit(1)).alias("rows"),
            F.any_value("bands").alias("bands"),
            F.any_value("code").alias("code"),
        )
        .withColumn("node", F.col("first.place"))
    )

    def spelled_out(wanted: DataFrame) -> DataFrame:
        # The joins are sorted at every size: what is small here and now need not be at scale.
        places = wanted.withColumnRenamed("node", "place").hint("merge")
        return _numbered_shingles(rows.select("place", "text").join(places, "place", "left_semi"), shingle)

    def cross(open_: DataFrame) -> DataFrame:
        return crossing(open_, spelled_out, similarity, PLANES, most_differences(similarity))

    def verify(pairs: DataFrame) -> DataFrame:
        spelled = materialised(spelled_out(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        of_a = spelled.select(F.col("node").alias("a"), F.col("shingles").alias("in_a")).hint("merge")
        of_b = spelled.select(F.col("node").alias("b"), F.col("shingles").alias("in_b")).hint("merge")
        both = F.size(F.array_intersect("in_a", "in_b"))
        alike = both >= F.lit(similarity) * (F.size("in_a") + F.size("in_b") - both) - F.lit(1e-9)
        return pairs.join(of_a, "a").join(of_b, "b").filter(alike).select("a", "b")

    members = nodes.select("node", F.explode("bands").alias("key"))
    groups = linked(members, verify, nodes.select("node", "code"), cross=cross)
    placed = nodes.join(groups, "node", "left").select(
        *prints, "first", "rows", F.coalesce("component", "node").alias("component")
    )
    heads = placed.groupBy("component").agg(F.min("first").alias("head"), F.sum("rows").alias("class_size"))
    of_text = placed.join(heads, "component").select(*prints, "head", "class_size")
    return sketch.join(of_text, prints, "left").select(
        "doc_id",
        "place",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce(F.col("place") == F.col("head.place"), F.lit(True)).alias("kept"),
    )


def kept_documents(documents: DataFrame) -> DataFrame:
    """One document of each class, with its own columns."""
    documents = replayable(documents)
    rows = documents.select(row_column(documents).alias("row"), F.monotonically_increasing_id().alias("place"))
    stay = materialised(classes(documents).filter("kept").select(F.col("place").alias("stays")))
    # Sorted at every size: the rows that stay grow with the table.
    return rows.join(stay.hint("merge"), F.col("place") == F.col("stays"), "left_semi").select("row.*")
