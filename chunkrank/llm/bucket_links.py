"""Links between the members of one bucket, found where the bucket is read; no pair becomes a row.

A bucket is cut into blocks of bounded size, and every two blocks (a block with itself, too) are a group
of rows for one task. There all pairs are compared at once: first by codes, then, of those left, by the
elements themselves. What a group sends is a forest: edges that connect what was apart, fewer than its
members. So a bucket of n members makes n/block copies of its rows and n edges, not the square of n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkrank.llm.tables import materialised

BLOCK = 512
#: Elements that are compared at a time, for all members of a group.
ELEMENTS = 4096
GROUP = ("key", "low", "high")


def in_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members (key, node, …) with the pairs of blocks they belong to: low, high and which of both."""
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine")
    placed = members.join(sizes, "key").select(*members.columns, mine, other)
    low, high = F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")
    return placed.select(*members.columns, low, high, "mine")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one group each, of rows that are sorted by group."""
    held: list[pa.Table] = []
    key = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        numbers = np.stack([table[c].to_numpy() for c in GROUP])
        cuts = np.flatnonzero((numbers[:, 1:] != numbers[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            own = tuple(numbers[:, a].tolist())
            if own != key and held:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            key = own
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and the size of each list."""
    lists = column.combine_chunks()
    return np.asarray(lists.flatten()), np.asarray(lists.value_lengths()).astype(np.int64)


def alike_codes(codes: np.ndarray, planes: int, most_differences: float) -> np.ndarray:
    """Which pairs of rows differ in no more than so many coordinates; a code is its planes in order."""
    n, words = len(codes), codes.shape[1] // planes
    differ = np.zeros((n, n), np.int32)
    for w in range(words):
        either = np.zeros((n, n), np.uint64)
        for p in range(planes):
            plane = codes[:, p * words + w].view(np.uint64)
            either |= plane[:, None] ^ plane[None, :]
        differ += np.bitwise_count(either)
    return differ <= most_differences


def shared_elements(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many distinct elements every two lists share."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    pair = np.unique(np.stack([values.astype(np.int64), row]), axis=1)
    # Elements of one list alone are shared by nobody.
    element, number, times = np.unique(pair[0], return_inverse=True, return_counts=True)
    often = times[number.reshape(-1)] > 1
    number, row = np.unique(number.reshape(-1)[often], return_inverse=True)[1].reshape(-1), pair[1][often]
    total = np.zeros((n, n), np.float32)
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, ELEMENTS):
        a, b = np.searchsorted(number, [first, first + ELEMENTS])
        held = np.zeros((n, ELEMENTS), np.float32)
        held[row[a:b], number[a:b] - first] = 1
        total += held @ held.T
    return total


def forest(alike: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ``alike`` that connect all components it connects, without a cycle."""
    edges: list[tuple[int, int]] = []
    open_ = np.ones(len(component), dtype=bool)
    for start in range(len(component)):
        if not open_[start]:
            continue
        reached = [*np.flatnonzero(open_ & (component == component[start])).tolist()]
        open_[reached] = False
        while reached:
            at = reached.pop()
            for other in np.flatnonzero(alike[at] & open_).tolist():
                if open_[other]:
                    edges.append((at, other))
                    more = np.flatnonzero(open_ & (component == component[other])).tolist()
                    open_[more] = False
                    reached += more
    return edges


def crossing(
    members: DataFrame, spelled: Callable[[DataFrame], DataFrame], similarity: float, planes: int, most_differences: float, block: int = BLOCK
) -> DataFrame:
    """Edges (a, b) between members (key, node, component, code) of one bucket and different components.

    ``spelled`` gives (node, shingles) of some nodes; it is asked for those with a partner whose code
    allows the similarity. Members of a pair of blocks are compared across them, within a block in the
    group of the block with itself.
    """
    placed = materialised(in_blocks(members, block))

    def candidates(group: pa.Table) -> np.ndarray:
        codes, sizes = _lists(group["code"])
        component, mine = group["component"].to_numpy(), group["mine"].to_numpy()
        apart = component[:, None] != component[None, :]
        if group["low"][0].as_py() != group["high"][0].as_py():
            apart &= mine[:, None] != mine[None, :]
        if not apart.any():
            return apart
        return apart & alike_codes(codes.reshape(len(sizes), -1), planes, most_differences)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            some = candidates(group).any(axis=1)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(group["node"].to_numpy()[some])], names=["node"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            pairs = candidates(group)
            if not pairs.any():
                continue
            values, sizes = _lists(group["shingles"])
            both = shared_elements(values, sizes).astype(np.float64)
            alike = pairs & (both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9)
            edges = forest(alike, group["component"].to_numpy())
            if edges:
                node = group["node"].to_numpy()
                ends = np.sort(node[np.array(edges)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    def by_group(rows: DataFrame) -> DataFrame:
        return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)

    wanted = by_group(placed.select(*GROUP, "mine", "node", "component", "code")).mapInArrow(asked, "node long")
    known = materialised(spelled(wanted.distinct()))
    named = placed.join(known.hint("merge"), "node").select(*GROUP, "mine", "node", "component", "code", "shingles")
    return by_group(named).mapInArrow(linked, "a long, b long").distinct()
