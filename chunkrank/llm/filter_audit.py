"""How filters interact: what each removes, at every place of every order, without filtering again.

1. One pass gives each document the set of filters it fails, as bits. Whether its text equals that of
   a smaller id is settled by digest: copies are counted per (digest, part, label) with their smallest
   id before they meet, so a text copied by a third of all rows is a handful of rows there.
2. The documents of a part are its histogram of failure masks: 2**filters rows at most.
3. Each part builds a decision diagram over its histogram. A node tests one filter, its two branches
   are "passes" and "fails", equal nodes are shared, and every node carries the documents below it
   (all, good, toxic). Exchanging two neighbouring levels only rebuilds the nodes of those two, and
   such exchanges lead through all orders. In each order the path on which everything passes gives
   the steps: its nodes hold what is left, the "fails" branches beside it what goes.

Defined cases: a null text is empty, a null part is the empty string; no words (an empty text) fails
the first filter only and may be a copy; very long texts are counted whole, in slices. An empty table
gives an empty result. Rows that share an id are documents of their own and no copies of each other;
a null id is neither smaller nor larger than any other. Label rows that share an id count once: good
(toxic) if one of them says so; other columns of either table are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkrank.llm.runs import byte_class, coded, runs
from chunkrank.llm.tables import map_batches
from chunkrank.llm.words import WHITE, Texts, slices

#: The audited filters, each failed by the documents its letter's condition in ``_failed`` holds for.
FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
CAPITALS = byte_class((ord("A"), ord("Z")))
SYMBOLS = byte_class(*[(ord(x), ord(x)) for x in "#$%&*|"])
COPY_BIT = 1 << FILTERS.index("E")


def _failed(texts: Texts) -> np.ndarray:
    """Bits of the filters that look at one text: A, B, C and D."""
    found, row = runs(texts.data, texts.offsets, ~WHITE[texts.data])
    codes, names = coded(found)
    words = np.bincount(row, minlength=texts.rows)
    each = np.unique(row * max(1, len(names)) + codes)
    distinct = np.bincount(each // max(1, len(names)), minlength=texts.rows)
    conditions = (
        words < LEAST_WORDS,
        100 * distinct < DISTINCT_PERCENT * words,
        100 * texts.count(CAPITALS[texts.data]) > CAPITAL_PERCENT * texts.code_points(),
        texts.count(SYMBOLS[texts.data]) > 0,
    )
    return sum(c.astype(np.int64) << bit for bit, c in enumerate(conditions))


def failures(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, digest, mask) of every document; ``mask`` has the bits of the text's own filters."""
    rows = documents.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        masks, digests = [np.zeros(0, np.int64)], []
        for texts in slices(batch.column("text")):
            masks.append(_failed(texts))
            data = memoryview(texts.data)
            at = texts.offsets.tolist()
            digests += [hashlib.sha256(data[a:b]).digest() for a, b in zip(at[:-1], at[1:])]
        arrays = [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(np.concatenate(masks))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "part", "digest", "mask"])

    return map_batches(rows, judge, "doc_id long, part string, digest binary, mask long")


def labelled(found: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Adds good and toxic (0 or 1) from the rows of ``labels`` with the document's id."""
    known = labels.groupBy(F.col(f"`{doc_id}`").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    flag = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    return found.join(known, "doc_id", "left").select("doc_id", "part", "digest", "mask", *flag)


def histogram(found: DataFrame) -> DataFrame:
    """(part, mask, documents, good, toxic): the mask now also says which documents are copies."""
    kind = ["digest", "mask", "part", "good", "toxic"]
    rows = found.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    low = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low")
    unnamed = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed")
    met = rows.groupBy(*kind).agg(low, F.sum("n").alias("n"), unnamed)
    # What is left per digest: a row for each part and label its copies have.
    smallest = F.min("low.doc_id").over(Window.partitionBy("digest"))
    first = F.when(F.col("low.doc_id") == smallest, F.col("low.n")).otherwise(F.lit(0)) + F.col("unnamed")
    sides = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("first").alias("documents")),
        F.struct(F.col("mask").bitwiseOR(F.lit(COPY_BIT)).alias("mask"), (F.col("n") - F.col("first")).alias("documents")),
    )
    split = met.withColumn("first", first).select("part", "good", "toxic", F.inline(sides))
    counts = [F.sum(F.col("documents") * F.col(c)).alias(c) for c in ("good", "toxic")]
    summed = split.groupBy("part", "mask").agg(F.sum("documents").alias("n"), *counts)
    return summed.filter("n > 0").select("part", "mask", F.col("n").alias("documents"), "good", "toxic")


Weight = tuple[int, int, int]


class Diagram:
    """A decision diagram over the failure masks of one part, every node with its weight.

    A node is (passes, fails) by number; a leaf has no branches. All paths test all filters, in the
    order of ``order``; nodes with equal branches on one level are one node.
    """

    def __init__(self, masks: dict[int, Weight], filters: str):
        self.filters = filters
        self.order = list(filters)
        self.branches: list[tuple[int, int] | None] = []
        self.weights: list[Weight] = []
        self.known: dict[tuple, int] = {}
        self.root = self._build(masks, 0)

    def _kept(self, key: tuple, branches: tuple[int, int] | None, weight: Weight) -> int:
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.weights)
            self.branches.append(branches)
            self.weights.append(weight)
        return at

    def _node(self, name: str, passes: int, fails: int) -> int:
        weight = tuple(a + b for a, b in zip(self.weights[passes], self.weights[fails]))
        return self._kept((name, passes, fails), (passes, fails), weight)

    def _build(self, masks: dict[int, Weight], level: int) -> int:
        if level == len(self.order):
            weight = tuple(sum(w[i] for w in masks.values()) for i in range(3))
            return self._kept(weight, None, weight)
        bit = 1 << self.filters.index(self.order[level])
        sides = [{m: w for m, w in masks.items() if bool(m & bit) == fails} for fails in (False, True)]
        return self._node(self.order[level], *[self._build(side, level + 1) for side in sides])

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next; nodes below both stay as they are."""
        upper, lower = self.order[level], self.order[level + 1]
        done: dict[int, int] = {}

        def rebuilt(node: int, depth: int) -> int:
            if node not in done:
                passes, fails = self.branches[node]
                if depth < level:
                    done[node] = self._node(self.order[depth], rebuilt(passes, depth + 1), rebuilt(fails, depth + 1))
                else:
                    (pp, pf), (fp, ff) = self.branches[passes], self.branches[fails]
                    done[node] = self._node(lower, self._node(upper, pp, fp), self._node(upper, pf, ff))
            return done[node]

        self.root = rebuilt(self.root, 0)
        self.order[level], self.order[level + 1] = lower, upper

    def steps(self) -> Iterator[tuple[str, Weight, Weight]]:
        """Per filter in order: what is left after it, and what it removes."""
        node = self.root
        for name in self.order:
            passes, fails = self.branches[node]
            yield name, self.weights[passes], self.weights[fails]
            node = passes


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels whose exchanges, one after the other, lead through all orders of n things."""
    if n < 2:
        return
    down = True
    for inner in [*adjacent_swaps(n - 1), None]:
        # The last thing walks through the others, which take one step whenever it is at an end.
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            yield inner + down
        down = not down


STEP_COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interactions(masks: dict[int, Weight], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, filter, *STEP_COLUMNS) of one part, for every order and step."""
    diagram = Diagram(masks, filters)
    seen = [("".join(diagram.order), list(diagram.steps()))]
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        seen.append(("".join(diagram.order), list(diagram.steps())))
    # A filter that comes first removes all it fails; one that comes last, what it alone fails.
    total = {steps[0][0]: steps[0][2][0] for _, steps in seen}
    alone = {steps[-1][0]: steps[-1][2][0] for _, steps in seen}
    removed = dict.fromkeys(filters, 0)
    for _, steps in seen:
        for name, _, gone in steps:
            removed[name] += gone[0]
    return [
        (order, at, name, left[0], gone[0], total[name] - gone[0], alone[name], gone[1], gone[2], removed[name])
        for order, steps in seen
        for at, (name, left, gone) in enumerate(steps, 1)
    ]


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order and step of every part of a ``histogram``; a group is at most 2**filters rows."""
    schema = "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} long" for c in STEP_COLUMNS)

    def of_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        numbers = rows[["mask", "documents", "good", "toxic"]].to_numpy().tolist()
        found = interactions({mask: tuple(weight) for mask, *weight in numbers}, filters)
        out = pd.DataFrame(found, columns=["filter_order", "step", "filter", *STEP_COLUMNS])
        out.insert(0, "part", key[0])
        return out

    return counts.groupBy("part").applyInPandas(of_part, schema)


def audited(documents: DataFrame, labels: DataFrame, columns: Sequence[str] = ("doc_id", "text", "lang")) -> DataFrame:
    return audit(histogram(labelled(failures(documents, *columns), labels)))
