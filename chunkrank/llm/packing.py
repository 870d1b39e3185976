"""Packing of tokenised documents into sequences of fixed capacity.

1. One pass tokenises every document, appends the end id, cuts what is longer than a sequence, and
   writes the pieces with their rank among the pieces of one length in their partition.
2. The histogram of lengths (at most ``capacity`` rows, whatever the corpus) goes to the driver. A
   configuration is a multiset of lengths that fits a sequence. The linear program over all
   configurations covers the histogram with as few sequences as possible; multiplicative weights
   solve it, a knapsack dynamic program prices the next configuration. Its solution is rounded
   down; what is left over best-fits, longest first, into the gaps and into new sequences. Of the
   plans that keep all, some or none of the rounded sequences, the one with fewest is taken.
3. The plan is a table of (length, ranks) -> (sequence, offset), again bounded by the capacity. Every
   piece finds its place by its length and its rank among all pieces of that length.

No piece meets another in a shuffle but for its rank: per-partition counts are summed per length.

Defined cases: null texts are empty and consist of the end id; repeated rows are packed each; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from operator import add
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkrank.llm.tables import materialised

CAPACITY = 4096
END_ID = 1

#: Lengths are rounded up to multiples of this in the linear program, not in the packing.
GRAIN = 8
#: Steps of the multiplicative weights, what one step may cover of a size, and the learning rate.
STEPS = 800
GAIN = 0.2
RATE = 12.0
#: Shares of the rounded solution (fullest sequences first) that best-fit is tried to complete.
SHARES = (1.0, 0.9, 0.7, 0.4, 0.0)

SIGNS = ".,;:!?%$&*#"
WHITE = re.compile("[\t\n\x0b\x0c\r]")
#: Words that a worker remembers before it starts anew (some 250 bytes each).
REMEMBERED = 700_000
LONGEST_REMEMBERED = 64
GROUP_CHARS = 1_000_000


# --- tokens ----------------------------------------------------------------------------------


class Encoder:
    """Ids of texts, word by word: no token of the vocabulary crosses ASCII white space.

    Nor does one cross from a letter to a sign (apostrophes, which open contractions, aside). So new
    words that the vocabulary's NFC and lower-casing leave all letters are encoded without the signs
    after them, ASCII ones in lower case, and many at a time: in the ids of a list of words, each word ends with the only token that has an end mark.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {"": b""}

    def _one_by_one(self, names: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(names, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters."""
        # The fast form leaves out the offsets, which are not used.
        found = self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
        ids = np.array(found.ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._one_by_one(words)
        raw = ids.tobytes()
        bounds = [0, *(4 * cuts).tolist()]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def learn(self, names: list[str]) -> list[str]:
        """Remember the ids of new words; returns the stems that are too long to keep for long."""
        plain, parted, stems, tails = [], [], [], []
        for name in names:
            stem = name.rstrip(SIGNS)
            if stem.isalpha():
                if stem.isascii():
                    stems.append(stem.lower())
                elif normalize("NFC", stem).lower().isalpha():
                    stems.append(stem)
                else:
                    plain.append(name)
                    continue
                parted.append(name)
                tails.append(name[len(stem) :])
            else:
                plain.append(name)
        known = self.stems
        if new := list(set(stems).difference(known)):
            known.update(zip(new, self._together(new)))
        if new := list(set(tails).difference(known)):
            known.update(zip(new, self._one_by_one(new)))
        ids = known.__getitem__
        self.known.update(zip(parted, map(add, map(ids, stems), map(ids, tails))))
        if plain:
            self.known.update(zip(plain, self._one_by_one(plain)))
        return [stem for stem in stems if len(stem) > LONGEST_REMEMBERED]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        if len(self.stems) > REMEMBERED // 2:
            self.stems = {"": b""}
        split = [WHITE.sub(" ", text).split(" ") for text in texts]
        missing = list(set().union(*split).difference(self.known))
        long = self.learn(missing)
        out = [b"".join(map(self.known.__getitem__, names)) for names in split]
        for name in missing:
            if len(name) > LONGEST_REMEMBERED:
                del self.known[name]
        for stem in long:
            self.stems.pop(stem, None)
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _groups(values: list[str]) -> Iterator[tuple[int, list[str]]]:
    group: list[str] = []
    size = first = 0
    for i, value in enumerate(values):
        group.append(value)
        size += len(value)
        if size >= GROUP_CHARS:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group


def pieces(
    documents: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids], and the place in the partition.

    ``part`` is the partition and ``local_rank`` counts the earlier pieces of this length in it.
    """
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    end = np.array([END_ID], dtype="<u4").tobytes()
    schema = rows.select("doc_id").schema
    for name in ("piece", "start", "length", "ids_crc32", "part", "local_rank"):
        schema = schema.add(name, T.IntegerType() if name in ("piece", "part") else T.LongType(), False)
    if keep_ids:
        schema = schema.add("ids", T.BinaryType())
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for first, group in _groups([v.as_py() or "" for v in batch.column("text")]):
                source, number, start, length, crc, rank, kept = [], [], [], [], [], [], []
                for i, ids in enumerate(own.encode(group), first):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), width)):
                        own_ids = ids[at : at + width]
                        size = len(own_ids) // 4
                        source.append(i)
                        number.append(n)
                        start.append(at // 4)
                        length.append(size)
                        crc.append(zlib.crc32(own_ids))
                        rank.append(int(seen[size]))
                        seen[size] += 1
                        if keep_ids:
                            kept.append(own_ids)
                arrays = [
                    batch.column("doc_id").take(pa.array(source, pa.int64())),
                    pa.array(number, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                    pa.array([part] * len(source), pa.int32()),
                    pa.array(rank, pa.int64()),
                ]
                if keep_ids:
                    arrays.append(pa.array(kept, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(cut, schema)


# --- the plan, from the histogram alone ------------------------------------------------------

#: A group of equal sequences: how many, and (length, how often) in the order of the sequence.
Group = tuple[int, tuple[tuple[int, int], ...]]


def _size(group: Group) -> int:
    return sum(n * m for n, m in group[1])


def price(value: np.ndarray, room: int) -> np.ndarray:
    """How often each size 1 … room occurs in the most valuable multiset of total size <= room."""
    best = np.zeros(room + 1)
    took = np.zeros(room + 1, dtype=np.int64)
    backwards = value[1 : room + 1]
    for c in range(1, room + 1):
        gain = best[c - 1 :: -1][:c] + backwards[:c]
        u = int(np.argmax(gain))
        if gain[u] > best[c - 1]:
            best[c], took[c] = gain[u], u + 1
        else:
            best[c] = best[c - 1]
    out = np.zeros(room + 1, dtype=np.int64)
    while room > 0:
        if took[room]:
            out[took[room]] += 1
            room -= int(took[room])
        else:
            room -= 1
    return out


def fractional(demand: np.ndarray, steps: int = STEPS) -> list[tuple[float, np.ndarray]]:
    """Configurations with their number, together as large as the demand.

    ``demand[u]`` counts the pieces of size u. Multiplicative weights: sizes that the solution has
    covered least weigh most, and the best configuration for the weights is added each time.
    """
    room = len(demand) - 1
    wanted = demand > 0
    if not wanted.any():
        return []
    covered = np.zeros(room + 1)
    found: dict[bytes, list] = {}
    for _ in range(steps):
        lead = np.where(wanted, covered / np.maximum(demand, 1), np.inf)
        weight = np.exp(-RATE * (lead - lead.min()))
        config = price(weight / np.maximum(demand, 1), room)
        held = config > 0
        often = GAIN * float((demand[held] / config[held]).min())
        covered += often * config
        found.setdefault(config.tobytes(), [0.0, config])[0] += often
    size = np.arange(room + 1)
    scale = float(size @ demand) / float(size @ covered)
    return [(x * scale, config) for x, config in found.values()]


def _rounded(counts: np.ndarray, capacity: int, grain: int) -> list[Group]:
    """Whole sequences of the rounded-down solution; takes their pieces out of ``counts``."""
    sizes = -(-np.arange(capacity + 1) // grain)
    room = capacity // grain
    demand = np.bincount(sizes[: capacity + 1], weights=counts, minlength=room + 1)[: room + 1]
    demand[0] = 0
    groups: list[Group] = []
    pools = {u: [n for n in range(min(capacity, u * grain), (u - 1) * grain, -1)] for u in range(1, room + 1)}
    for often, config in sorted(fractional(demand), key=lambda x: -x[0]):
        left = int(often)
        slots = [int(u) for u in np.flatnonzero(config) for _ in range(config[u])]
        while left:
            # The longest pieces of every size; as many equal sequences as they last for.
            content: dict[int, int] = defaultdict(int)
            for u in slots:
                n = next((n for n in pools[u] if counts[n] > content.get(n, 0)), None)
                if n is None:
                    left = 0
                    break
                content[n] += 1
            if not left:
                break
            times = min(left, *(int(counts[n]) // m for n, m in content.items()))
            for n, m in content.items():
                counts[n] -= times * m
            groups.append((times, tuple(sorted(content.items(), reverse=True))))
            left -= times
    return groups


def best_fit(counts: np.ndarray, capacity: int, groups: list[Group]) -> list[Group]:
    """Add the counted pieces, longest first, each where the least room is left over."""
    gaps: list[list[Group]] = [[] for _ in range(capacity + 1)]
    for group in groups:
        gaps[capacity - _size(group)].append(group)
    filled = np.array([bool(x) for x in gaps])
    for n in range(capacity, 0, -1):
        left = int(counts[n])
        while left:
            gap = n + int(np.argmax(filled[n:])) if filled[n:].any() else capacity
            if filled[gap]:
                times, content = gaps[gap].pop()
            else:
                times, content = -(-left // (capacity // n)), ()
            each = gap // n
            full = min(times, left // each)
            parts = [(full, each)] if full else []
            if full < times and left - full * each:
                parts.append((1, left - full * each))
            used = sum(t for t, _ in parts)
            if used < times and content:
                gaps[gap].append((times - used, content))
            for t, m in parts:
                gaps[gap - m * n].append((t, (*content, (n, m))))
                filled[gap - m * n] = True
                left -= t * m
            filled[gap] = bool(gaps[gap])
    return [g for gap in gaps for g in gap]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Groups of equal sequences that hold exactly the pieces of the histogram."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, often in histogram.items():
        counts[n] = often
    rest = counts.copy()
    rounded = sorted(_rounded(rest, capacity, GRAIN), key=lambda g: capacity - _size(g))
    plans = []
    for share in SHARES:
        taken = rounded[: round(share * len(rounded))]
        rest = counts.copy()
        for times, content in taken:
            for n, m in content:
                rest[n] -= times * m
        plans.append(best_fit(rest, capacity, taken))
    return min(plans, key=lambda groups: sum(times for times, _ in groups))


def places(groups: list[Group], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by runs of their ranks."""
    rows: list[tuple[int, int, int, int, int]] = []
    next_rank = np.zeros(capacity + 1, dtype=np.int64)
    sequence = 0
    for times, content in groups:
        offset = 0
        for n, m in content:
            rows.append((n, int(next_rank[n]), m, sequence, offset))
            next_rank[n] += times * m
            offset += n * m
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T))


# --- the operator ----------------------------------------------------------------------------


def packed(
    documents: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids], sequence_id and offset of every piece."""
    cut = materialised(pieces(documents, tokenizer, capacity, doc_id, text, keep_ids))
    per_part = materialised(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("rows")))
    histogram = per_part.groupBy("length").agg(F.sum("rows").alias("rows")).collect()
    table = places(plan({r["length"]: r["rows"] for r in histogram}, capacity), capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", "length", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["part", "length"]).select(
        *[c for c in cut.columns if c not in ("part", "local_rank")],
        (F.col("before") + F.col("local_rank")).alias("rank"),
    )
    names = [c for c in ranked.columns if c != "rank"]
    schema = ranked.select(*names).schema.add("sequence_id", "long", False).add("offset", "long", False)
    span = 1 << 44
    keys = table["length"] * span + table["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = np.searchsorted(keys, length * span + rank, side="right") - 1
            beyond = rank - table["rank"][row]
            each = table["each"][row]
            sequence = table["sequence"][row] + beyond // each
            offset = table["offset"][row] + beyond % each * length
            arrays = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return ranked.mapInArrow(place, schema)
