"""Repeated passages: suffix subtrees of prefix groups, and the texts without later copies.

A suffix starts at every word. Two suffixes that share their first ``least`` words meet in an inner
node at that depth or deeper, and all but the earliest leaf below the node of depth ``least`` begin a
repeated window. Runs of such windows are the maximal repeats.

1. Texts with equal words: only the first takes part; later ones are repeats as a whole.
2. Every window has the smallest hash of its 5-word grams as anchor. Windows that are equal have
   equal anchors, so only those whose anchor occurs in two texts, or twice in one, can repeat. Counting
   anchors combines before the shuffle.
3. Each remaining suffix is a row: its first words as three edge labels (32-bit hashes of a quarter,
   a quarter and half of the window) and its place. Groups share a prefix of variable length: half a window, or the whole
   window where the anchor is in very many texts, and such a group is split further by text.
4. Rows of a group are sorted by edge labels and place. Neighbours that share all labels hang under
   one deep node; the first is its earliest leaf. The subtree is read off the sorted rows as they
   stream by, so a group of any size needs constant memory. Earliest leaves of split groups meet
   once more.
5. Marked window starts go back to their texts, which lose the words these windows cover.

Windows are compared by the 96 bits of their labels.

Defined cases: null texts have no words; texts shorter than a window lose nothing; earlier means a
smaller id (null last), then an earlier row, then an earlier start; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkrank.llm.near_dups import fingerprints
from chunkrank.llm.tables import map_batches, materialised, replayable
from chunkrank.llm.words import Texts, keyed, repeated, slices, sliding_minimum, windows

LEAST = 20
GRAM = 5
#: Windows whose anchor is in more texts than this are grouped by their whole length, and in parts.
MANY_TEXTS = 500
PARTS = 64
PART_BITS = PARTS.bit_length()
START_BITS = 32 - PART_BITS
NULL_ID = (1 << 63) - 1


def _anchors(texts: Texts, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window, and its anchor; the lowest bit says that its text has the gram twice."""
    starts = texts.whole_windows(least)
    grams = windows(texts.word_hashes, GRAM)
    twice = repeated(keyed(grams, texts.word_row[: len(grams)]))
    marked = (grams & ~np.uint64(1)) | twice.astype(np.uint64)
    return starts, sliding_minimum(marked, least - GRAM + 1)[starts]


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate([*parts, np.zeros(0, kind)])


def anchored(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(place, n_words, prints) of every text, and (place, print, anchor, twice) of its anchors.

    One pass writes both: the anchors of a text are in its row.
    """

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, prints, counts, anchors = [], [], [], []
        for texts in slices(batch.column("text")):
            sizes.append(np.diff(texts.first_word))
            prints.append(fingerprints(texts))
            starts, anchor = _anchors(texts, least)
            rows = texts.word_row[starts]
            order = np.lexsort((anchor, rows))
            rows, anchor = rows[order], anchor[order]
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:] != rows[:-1]) | (anchor[1:] != anchor[:-1])
            counts.append(np.bincount(rows[new], minlength=texts.rows))
            anchors.append(_signed(anchor[new]))
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *counts]))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_joined(anchors)))
        both = [pa.array(_joined([_signed(p[i]) for p in prints])) for i in (0, 1)]
        arrays = [batch.column("id_order"), batch.column("place"), pa.array(_joined(sizes)), *both, lists]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["id_order", "place", "n_words", "print_a", "print_b", "anchors"]
    schema = "id_order long, place long, n_words long, print_a long, print_b long, anchors array<bigint>"
    found = materialised(map_batches(documents, find, schema))
    anchor = F.explode("anchors").alias("x")
    each = found.select("place", "print_a", anchor).select(
        "place", "print_a", F.shiftrightunsigned("x", 1).alias("anchor"), F.col("x").bitwiseAND(1).alias("twice")
    )
    return found.drop("anchors"), each


def candidates(documents: DataFrame, least: int) -> DataFrame:
    """(place, whole, anchors, hot) of the texts with something that may be repeated.

    ``whole`` marks later copies of a whole text; the others have their repeated anchors.
    """
    texts, each = anchored(documents, least)
    first = F.struct("id_order", "place")
    firsts = (
        texts.filter(F.col("n_words") >= least)
        .groupBy("print_a", "print_b", "n_words")
        .agg(F.min(first)["place"].alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )
    copies = (
        texts.join(firsts, ["print_a", "print_b", "n_words"]).filter("place <> first").select("place", F.lit(True).alias("whole"))
    )
    shared = (
        each.groupBy("anchor")
        .agg(
            F.max("twice").alias("twice"),
            F.min("print_a").alias("low"),
            F.max("print_a").alias("high"),
            F.count(F.lit(1)).alias("texts"),
        )
        .filter("twice = 1 or low < high")
        .select("anchor", (F.col("texts") > MANY_TEXTS).alias("hot"))
    )
    in_text = (
        each.join(shared, "anchor")
        .groupBy("place")
        .agg(
            F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("anchors"),
            F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"),
        )
    )
    return materialised(
        in_text.join(copies, "place", "full").select(
            "place", F.coalesce("whole", F.lit(False)).alias("whole"), "anchors", "hot"
        )
    )


def suffixes(texts: DataFrame, least: int) -> DataFrame:
    """The suffixes that may be repeated: edge labels (the first two in one number), place, and group.

    ``tail`` holds the third label, the part of a hot group (from 1 on, or 0 in cold groups) and the last
    bits of the start, whose rest is ``far``, 0 but in texts of millions of words: fewer bytes in each of
    very many rows.
    """
    sizes = (least // 4, least // 4, least - least // 4 * 2)
    offsets = (0, sizes[0], sizes[0] + sizes[1])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        known = [batch.column(n) for n in ("anchors", "hot")]
        ids = batch.column("id_order").to_numpy(zero_copy_only=False)
        places = batch.column("place").to_numpy(zero_copy_only=False)
        for part in slices(batch.column("text")):
            starts, anchor = _anchors(part, least)
            rows = part.word_row[starts]
            own = keyed(anchor >> np.uint64(1), rows)
            held = []
            for lists in known:
                some = lists.slice(part.first, part.rows)
                flat = np.asarray(some.flatten()).astype(np.int64).view(np.uint64)
                row = np.repeat(np.arange(part.rows), np.asarray(some.value_lengths().fill_null(0)))
                held.append(np.isin(own, keyed(flat, row)))
            keep = held[0] | held[1]
            starts, rows, hot = starts[keep], rows[keep], held[1][keep]
            label = [
                windows(part.word_hashes, n)[starts + at] >> np.uint64(32) if len(starts) else starts.view(np.uint64)
                for n, at in zip(sizes, offsets)
            ]
            head = (label[0] << np.uint64(32)) | label[1]
            split = np.where(hot, places[part.first + rows] % PARTS + 1, 0)
            at = starts - part.first_word[rows]
            tail = label[2].astype(np.int64) << 32 | split << START_BITS | at & ((1 << START_BITS) - 1)
            far = at >> START_BITS
            for column, values in zip(out, (_signed(head), tail, ids[part.first + rows], places[part.first + rows], far)):
                column.append(values)
        kinds = (np.int64, np.int64, np.int64, np.int64, np.int32)
        arrays = [pa.array(_joined(c, k).astype(k)) for c, k in zip(out, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=["head", "tail", "id_order", "place", "far"])

    return map_batches(texts, cut, "head long, tail long, id_order long, place long, far int")


def _node() -> Column:
    """What rows of one node and part share of ``tail``: all but the start."""
    return F.shiftright("tail", START_BITS)


def _leaves(rows: DataFrame) -> DataFrame:
    """Adds ``first`` (earliest leaf of its deep node in this group) to rows sorted within groups."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            node = np.stack([batch.column("head").to_numpy(), batch.column("tail").to_numpy() >> START_BITS])
            first = np.ones(len(batch), dtype=bool)
            first[1:] = (node[:, 1:] != node[:, :-1]).any(axis=0)
            if last is not None:
                first[0] = bool((node[:, 0] != last).any())
            last = node[:, -1].copy()
            yield batch.append_column("first", pa.array(first))

    schema = T.StructType([*rows.schema.fields, T.StructField("first", T.BooleanType())])
    return rows.mapInArrow(read, schema)


def repeats(found: DataFrame) -> DataFrame:
    """(place, start) of every window that is not the earliest of its kind."""
    # A cold group is a prefix of half a window; a hot one the whole window and a part of the texts.
    split = _node().bitwiseAND(F.lit((1 << PART_BITS) - 1))
    prefix = F.when(split == 0, F.col("head")).otherwise(F.xxhash64("head", _node()))
    partitioned = found.withColumn("prefix", prefix).repartition("prefix").drop("prefix")
    near = F.col("tail").bitwiseAND(F.lit((1 << START_BITS) - 1)).cast("int")
    start = F.shiftleft("far", START_BITS).bitwiseOR(near).alias("start")
    leaves = _leaves(partitioned.sortWithinPartitions("head", _node(), "id_order", "place", "far", "tail")).select("*", start)
    cold = leaves.filter("not first")
    # Earliest leaves of the parts of a split node: at most one a part, so these groups are small.
    parts = leaves.filter(F.col("first") & (split > 0)).withColumn("label", F.shiftright("tail", 32))
    mine = F.struct("id_order", "place", "start")
    node = parts.groupBy("head", "label").agg(F.min(mine).alias("earliest"))
    later = parts.join(node, ["head", "label"]).filter(mine != F.col("earliest"))
    return cold.select("place", "start").unionByName(later.select("place", "start"))


def cleaned(
    documents: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 [, text: the kept words] of every document."""
    rows = replayable(documents).select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_ID)).alias("id_order"),
        F.monotonically_increasing_id().alias("place"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    found = candidates(rows.select("id_order", "place", "text"), least)
    texts = rows.join(found, "place", "left")
    open_texts = texts.filter("not whole").select("id_order", "place", "text", "anchors", "hot")
    marks = repeats(suffixes(open_texts, least)).groupBy("place").agg(F.collect_list("start").alias("starts"))
    marked = texts.select("doc_id", "place", "text", "whole").join(marks, "place", "left").drop("place")
    schema = marked.select("doc_id").schema.add("n_words", "long", False).add("n_removed", "long", False)
    schema = schema.add("kept_sha256", "string", False)
    if keep_text:
        schema = schema.add("text", "string", False)

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, removed, digests, kept_texts = [], [], [], []
        whole = batch.column("whole")
        starts = batch.column("starts")
        for part in slices(batch.column("text")):
            begin, end = part.words
            data = part.data.tobytes()
            for row in range(part.rows):
                a, b = int(part.first_word[row]), int(part.first_word[row + 1])
                keep = np.ones(b - a, dtype=bool)
                if whole[part.first + row].as_py():
                    keep[:] = False
                elif (at := starts[part.first + row]).is_valid:
                    cover = np.zeros(b - a + 1, dtype=np.int64)
                    at = np.asarray(at.values)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + least, -1)
                    keep = np.cumsum(cover)[:-1] == 0
                chosen = np.flatnonzero(keep) + a
                kept = b" ".join([data[x:y] for x, y in zip(begin[chosen].tolist(), end[chosen].tolist())])
                words.append(b - a)
                removed.append(b - a - len(chosen))
                digests.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    kept_texts.append(kept.decode())
        arrays = [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        if keep_text:
            arrays.append(pa.array(kept_texts, pa.string()))
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_batches(marked, strip, schema)
