"""Byte strings that earlier documents hold too, by suffix arrays built bucket by bucket.

A suffix starts at every byte that begins a window of ``least`` bytes inside its text; suffixes are
ordered and compared by their window. Sorting all of them at once would take many times the input, so
buckets of suffixes that can be equal are brought together and sorted one at a time:

1. Later copies of a whole text are found by digest; they are covered as a whole and take no further
   part (the first copy has all their windows).
2. The smallest hash of the short strings in a window, its anchor, depends on the window alone, so equal
   windows have equal anchors. A run of windows with one anchor is a context. Batches of rows send
   their distinct anchors, packed 6 bytes each, to the bucket of the anchor; an anchor that two
   documents of a batch share goes once. Buckets answer with the anchors that occur elsewhere too.
3. Only those contexts are cut from the texts and sent to the bucket of their anchor, again packed.
   Equal contexts of a batch meet before: only the ones of the smallest id go on, the others are covered.
4. A bucket concatenates its distinct contexts to one text and builds the suffix array of their
   windows blockwise: positions p with p mod v in a difference cover D of v are ranked first, by the
   least - v + 1 bytes from there. Splitters cut the suffixes into blocks by their first bytes; a block
   is sorted by the first v and the last v - 1 bytes of the windows. What ties is decided by ranks: for
   any two suffixes there is a distance below v at which both are at a position of the sample, and the
   ranks there cover what is between. So memory is the text, the ranks, and one block.
   Neighbours with equal windows are a class; whoever has a larger id than the class's smallest is
   covered there.
5. Covered ranges return to their batch of rows, which cuts them out.

All comparisons that decide are of bytes; hashes (anchors) only choose what is compared.

Defined cases: null texts are empty; texts shorter than a window lose nothing; earlier means a smaller
id, so rows that share an id cover nothing of each other, and null ids come last and share that place;
texts may be of any length (windows are never cut off) and are cut as bytes, so what is kept need not be
UTF-8; an empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, cmp_to_key
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkrank.llm.tables import materialised, replayable
from chunkrank.llm.words import Texts, mix, slices, sliding_minimum

LEAST = 50
NULL_ID = (1 << 63) - 1
#: Consecutive rows handled together: 2**9, so a row's number in its batch fits the packed form.
BATCH_BITS = 9
SEVERAL = 0xFFFF
#: A bucket stands for about so many bytes of text; there are 2**4 to 2**16 buckets.
BUCKET_BYTES = 16 << 20
BUCKET_BITS = (4, 16)
#: Contexts of about so many bytes are made one text; suffixes sorted at a time.
POOL_BYTES = 8 << 20
BLOCK_SUFFIXES = 1 << 19


# --- texts and anchors -------------------------------------------------------------------------


def _packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number that sorts like them; zeros follow the end."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(n, np.uint64)
    for shift in range(min(8, n)):
        many = (n - shift + 7) // 8
        out[shift::8] = padded[shift : shift + 8 * many].view(">u8")
    return out


def _fields(packed: np.ndarray, at: np.ndarray | slice, n: int) -> list[np.ndarray]:
    """n bytes from each position as numbers, first bytes first."""

    def moved(by: int) -> np.ndarray:
        return packed[slice(at.start + by, at.stop + by) if isinstance(at, slice) else at + by]

    out = [moved(k) for k in range(0, n - 7, 8)]
    if n % 8:
        out.append(moved(n - n % 8) >> np.uint64(64 - 8 * (n % 8)))
    return out


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    many = max(0, len(data) - gram + 1)
    total = np.zeros(many, np.uint64)
    for field in _fields(_packed(data), slice(0, many), gram):
        total = (total ^ field) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
    return mix(total)


def _anchored(texts: Texts, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows and anchor of every context of a slice."""
    gram = max(1, least // 3)
    anchor = sliding_minimum(_gram_hashes(texts.data, gram), least - gram + 1)
    begins, ends = texts.offsets[:-1], np.maximum(texts.offsets[:-1], texts.offsets[1:] - least + 1)
    held = begins < ends
    begins, ends = begins[held], ends[held]
    edge = np.zeros(len(anchor) + 1, np.int8)
    edge[begins] += 1
    np.subtract.at(edge, ends, 1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= anchor[1:] != anchor[:-1]
    new[begins] = True
    first = np.flatnonzero(new)
    row = np.searchsorted(texts.offsets, first, side="right") - 1
    last = np.append(first[1:], len(anchor))
    end = np.minimum(last, texts.offsets[row + 1] - least + 1)
    # Bits of a minimum are mostly zero; mixed again they are even.
    return row, first, end - first, mix(anchor[first] + np.uint64(least))


def _numbers(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers packed in a binary column, and how many each row has."""
    rows = column.to_pylist()
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(rows), kind), np.array([len(x) // size for x in rows], np.int64)


def _packs(bounds: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """Consecutive entries of each column as one binary value per stretch between the bounds."""
    out = []
    for values in columns:
        at = (bounds * values.dtype.itemsize).astype(np.int64)
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])
        out.append(data.cast(pa.binary()))
    return out


def _stretches(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of a sorted array, and their bounds."""
    new = np.ones(len(groups) + 1, dtype=bool)
    new[1:-1] = groups[1:] != groups[:-1]
    bounds = np.flatnonzero(new) if len(groups) else np.zeros(1, np.int64)
    return groups[bounds[:-1]], bounds


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of the data, one after the other, as binary values."""
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    at = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data[at])])


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of binary values."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


class _Rows:
    """A batch of rows with their numbers in it, without the texts that are copies."""

    def __init__(self, texts: pa.Table, about: pa.Table):
        self.number = texts["idx"].to_numpy().astype(np.int64)
        self.id = texts["id_order"].to_numpy().astype(np.int64)
        copied = about["copied"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.copied = np.isin(self.number, copied)
        self.column = texts["text"].combine_chunks()

    def contexts(self, least: int) -> Iterator[tuple[Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per slice: the texts, and row (in the batch), first window, windows and anchor."""
        for texts in slices(pc.if_else(pa.array(self.copied), pa.scalar(None, self.column.type), self.column)):
            row, first, size, anchor = _anchored(texts, least)
            yield texts, row + texts.first, first, size, anchor


# --- which anchors occur in two documents ---------------------------------------------------------

ENTRIES = "bucket int, batch long, known boolean, keys binary, idx binary"


def _entries(rows: _Rows, batch: int, least: int, bits: int) -> pa.Table:
    """Anchors of a batch for their buckets; ``known`` ones are shared inside the batch already."""
    pairs = [np.zeros(0, np.uint64)]
    for _, row, _, _, anchor in rows.contexts(least):
        key = anchor >> np.uint64(32 - bits)
        pairs.append(np.unique(key << np.uint64(BATCH_BITS) | rows.number[row].astype(np.uint64)))
    pair = np.sort(np.concatenate(pairs))
    key = pair >> np.uint64(BATCH_BITS)
    number = (pair & np.uint64((1 << BATCH_BITS) - 1)).astype(np.uint16)
    new = np.ones(len(key) + 1, dtype=bool)
    new[1:-1] = key[1:] != key[:-1]
    shared = ~(new[:-1] & new[1:])
    sent = new[:-1]
    out = []
    for known, some, idx in ((False, sent, np.where(shared, SEVERAL, number).astype(np.uint16)), (True, shared, number)):
        bucket, bounds = _stretches((key[some] >> np.uint64(32)).astype(np.int32))
        low = (key[some] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        n = len(bucket)
        arrays = [pa.array(bucket), pa.array(np.full(n, batch)), pa.array(np.full(n, known)), *_packs(bounds, low, idx[some])]
        out.append(pa.table(arrays, names=["bucket", "batch", "known", "keys", "idx"]))
    return pa.concat_tables(out)


def _answers(entries: pa.Table) -> pa.Table:
    """Of a bucket's anchors those that occur twice, for the batches that sent them."""
    known = entries.filter(entries["known"])
    asked = entries.filter(pc.invert(entries["known"]))
    key, sizes = _numbers(asked["keys"], np.uint32)
    idx, _ = _numbers(asked["idx"], np.uint16)
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    shared = np.zeros(len(key), dtype=bool)
    shared[order] = same[1:] | same[:-1]
    shared &= idx != SEVERAL
    of_row = np.repeat(np.arange(len(sizes)), sizes)[shared]
    row, bounds = _stretches(of_row)
    back = asked.select(["bucket", "batch"]).take(pa.array(row))
    for name, column in zip(("keys", "idx"), _packs(bounds, key[shared], idx[shared])):
        back = back.append_column(name, column)
    return pa.concat_tables([back, known.select(["bucket", "batch", "keys", "idx"])])


# --- contexts of shared anchors -----------------------------------------------------------------

CONTEXTS = "bucket int, batch long, known boolean, idx binary, first binary, size binary, id binary, key binary, bytes binary"


def _ranges(bucket: int, batch: int, idx: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Table:
    """Covered bytes of rows of a batch."""
    bounds = np.array([0, len(idx)])
    packs = _packs(bounds, idx.astype(np.uint16), first.astype(np.int32), size.astype(np.int32))
    arrays = [pa.array([bucket], pa.int32()), pa.array([batch], pa.int64()), pa.array([True]), *packs]
    table = pa.table(arrays, names=["bucket", "batch", "known", "idx", "first", "size"])
    for name in ("id", "key", "bytes"):
        table = table.append_column(name, pa.nulls(1, pa.binary()))
    return table


def _contexts(rows: _Rows, batch: int, answers: pa.Table, least: int, bits: int) -> pa.Table:
    """The contexts with shared anchors; those that the batch itself shows to be covered as ranges."""
    key, sizes = _numbers(answers["keys"], np.uint32)
    idx, _ = _numbers(answers["idx"], np.uint16)
    bucket = np.repeat(answers["bucket"].to_numpy(), sizes).astype(np.uint64)
    wanted = np.sort((bucket << np.uint64(32) | key) << np.uint64(BATCH_BITS) | idx)
    columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
    keys, strings = [np.zeros(0, np.uint64)], [pa.array([], pa.large_binary())]
    for texts, row, first, size, anchor in rows.contexts(least) if len(wanted) else ():
        key = anchor >> np.uint64(32 - bits)
        pair = key << np.uint64(BATCH_BITS) | rows.number[row].astype(np.uint64)
        held = wanted[np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)] == pair
        row, first, size = row[held], first[held], size[held]
        for column, values in zip(columns, (row, first - texts.offsets[row - texts.first], size)):
            column.append(values)
        keys.append(key[held])
        strings.append(_gathered(texts.data, first, size + least - 1))
    row, first, size = (np.concatenate(c) for c in columns)
    key, string = np.concatenate(keys), pa.concat_arrays(strings)
    code = string.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids = rows.id[row]
    low = np.full(int(code.max(initial=-1)) + 1, NULL_ID)
    np.minimum.at(low, code, ids)
    later = ids > low[code]
    out = [_ranges(batch & ((1 << bits) - 1), batch, rows.number[row[later]], first[later], size[later] + least - 1)] if later.any() else []
    kept = np.flatnonzero(~later)
    kept = kept[np.argsort(key[kept], kind="stable")]
    row, first, size, key, string = row[kept], first[kept], size[kept], key[kept], string.take(pa.array(kept))
    bucket, bounds = _stretches((key >> np.uint64(32)).astype(np.int32))
    data, offsets = _bytes(string)
    low_key = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    packs = _packs(bounds, rows.number[row].astype(np.uint16), first.astype(np.int32), size.astype(np.int32), rows.id[row], low_key)
    n = len(bucket)
    arrays = [pa.array(bucket), pa.array(np.full(n, batch)), pa.array(np.zeros(n, dtype=bool)), *packs, *_packs(offsets[bounds], data)]
    return pa.concat_tables([*out, pa.table(arrays, names=["bucket", "batch", "known", "idx", "first", "size", "id", "key", "bytes"])])


# --- the suffix array of a pool of contexts ---------------------------------------------------------


@cache
def difference_cover(v: int) -> tuple[tuple[int, ...], np.ndarray]:
    """The smallest set with all differences mod v, and for two residues the least way to it for both."""
    for n in range(1, v + 1):
        for rest in combinations(range(1, v), n - 1):
            cover = (0, *rest)
            if len({(a - b) % v for a in cover for b in cover}) == v:
                inside = np.zeros(v, dtype=bool)
                inside[list(cover)] = True
                way = [[next(d for d in range(v) if inside[(r + d) % v] and inside[(s + d) % v]) for s in range(v)] for r in range(v)]
                return cover, np.array(way)
    raise ValueError(v)


class SuffixArray:
    """Classes of equal windows in a text made of contexts, found block by block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        self.least = least
        self.v = 1 << max(0, (least // 3).bit_length() - 1)
        self.packed = _packed(data)
        cover, self.way = difference_cover(self.v)
        reach = least - self.v + 1
        ends = np.repeat(offsets[1:], np.diff(offsets))
        at = np.arange(len(data))
        sample = np.flatnonzero(np.isin(at % self.v, cover) & (at + reach <= ends))
        fields = _fields(self.packed, sample, reach)
        order = np.lexsort(fields[::-1])
        new = np.zeros(len(order), dtype=np.int32)
        if len(order):
            new[1:] = np.any([f[order[1:]] != f[order[:-1]] for f in fields], axis=0)
        self.rank = np.full(len(data), -1, np.int32)
        self.rank[sample[order]] = np.cumsum(new, dtype=np.int32)
        self.starts = np.flatnonzero(at + least <= ends)

    def blocks(self) -> Iterator[np.ndarray]:
        """The suffixes, cut by splitters into blocks of suffixes with neighbouring first bytes."""
        head = _fields(self.packed, self.starts, min(8, self.least))[0]
        parts = -(-len(head) // BLOCK_SUFFIXES)
        if parts <= 1:
            yield self.starts
            return
        drawn = np.sort(head[:: max(1, len(head) // (64 * parts))])
        splitters = np.unique(drawn[np.arange(1, parts) * len(drawn) // parts])
        block = np.searchsorted(splitters, head, side="right")
        for number in range(len(splitters) + 1):
            some = self.starts[block == number]
            if len(some):
                yield some

    def classes(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A block's suffixes in order, and the class of each."""
        head = _fields(self.packed, suffixes, self.v)
        tail = _fields(self.packed, suffixes + self.least - self.v + 1, self.v - 1)
        order = np.lexsort([*tail[::-1], *head[::-1]])
        at = suffixes[order]
        tied = np.all([f[order[1:]] == f[order[:-1]] for f in (*head, *tail)], axis=0)
        residue = at % self.v
        way = self.way[residue[1:], residue[:-1]]
        equal = tied & (self.rank[at[1:] + way] == self.rank[at[:-1] + way])
        new = np.append(True, ~equal)[: len(at)]
        if (tied & ~equal).any():
            # Equal at both ends, different between: the ranks give the order.
            tie = np.cumsum(np.append(True, ~tied)[: len(at)])
            mixed = np.unique(tie[1:][tied & ~equal])
            for low, high in zip(np.searchsorted(tie, mixed), np.searchsorted(tie, mixed, side="right")):
                at[low:high], new[low:high] = self._ordered(at[low:high])
        return at, np.cumsum(new) - 1

    def _ordered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes with equal ends in the order of their ranks, and which begin a class."""
        residue = at % self.v
        own = self.rank[at + self.way[residue, residue]]
        # Inside a residue ranks compare directly; one of each rank meets the other residues.
        _, first, member = np.unique(residue * np.int64(1 << 32) + own, return_index=True, return_inverse=True)
        speaker = at[first].tolist()
        rank, way, v = self.rank, self.way, self.v

        def compare(a: int, b: int) -> int:
            d = way[speaker[a] % v, speaker[b] % v]
            return int(rank[speaker[a] + d]) - int(rank[speaker[b] + d])

        order = sorted(range(len(speaker)), key=cmp_to_key(compare))
        place = np.zeros(len(order), np.int64)
        for i, (a, b) in enumerate(zip(order, order[1:]), 1):
            place[b] = place[a] + (compare(a, b) != 0)
        of_member = place[member.reshape(-1)]
        sort = np.argsort(of_member, kind="stable")
        new = np.append(True, of_member[sort][1:] != of_member[sort][:-1])
        return at[sort], new


def covered(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, least: int) -> np.ndarray:
    """Which positions of the contexts begin a window that a context of a smaller id has too."""
    found = np.zeros(len(data), dtype=bool)
    array = SuffixArray(data, offsets, least)
    owner = np.repeat(ids, np.diff(offsets))
    for block in array.blocks():
        at, number = array.classes(block)
        first = np.searchsorted(number, np.arange(number[-1] + 1))
        low = np.minimum.reduceat(owner[at], first)
        found[at] = owner[at] > low[number]
    return found


def _marked(bucket: int, contexts: pa.Table, least: int) -> pa.Table:
    """The covered ranges of a bucket's contexts, by batch."""
    known = contexts.filter(contexts["known"]).select(["batch", "idx", "first", "size"])
    contexts = contexts.filter(pc.invert(contexts["known"]))
    batch = contexts["batch"].to_numpy()
    idx, many = _numbers(contexts["idx"], np.uint16)
    first, size, ids, key = (_numbers(contexts[c], k)[0] for c, k in (("first", np.int32), ("size", np.int32), ("id", np.int64), ("key", np.uint32)))
    data, _ = _numbers(contexts["bytes"], np.uint8)
    batch = np.repeat(batch, many)
    length = size.astype(np.int64) + least - 1
    at = np.cumsum(length) - length
    order = np.argsort(key, kind="stable")
    out: list[tuple[np.ndarray, ...]] = []
    _, bounds = _stretches(key[order])
    # Whole anchors up to a pool at a time.
    filled = np.concatenate([np.zeros(1, np.int64), np.cumsum(length[order])])[bounds]
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(filled, filled[low] + POOL_BYTES, side="right")) - 1)
        some = order[bounds[low] : bounds[high]]
        out += _of_pool(some, data, at, length, ids, key, least)
        low = high
    row, start, span = (np.concatenate([np.zeros(0, np.int64), *[x[i] for x in out]]) for i in range(3))
    order = np.argsort(batch[row], kind="stable")
    row, start, span = row[order], start[order], span[order]
    of_batch, bounds = _stretches(batch[row])
    packs = _packs(bounds, idx[row], (first[row] + start).astype(np.int32), span.astype(np.int32))
    return pa.concat_tables([known, pa.table([pa.array(of_batch, pa.int64()), *packs], names=["batch", "idx", "first", "size"])])


def _of_pool(some: np.ndarray, data: np.ndarray, at: np.ndarray, length: np.ndarray, ids: np.ndarray, key: np.ndarray, least: int) -> list[tuple[np.ndarray, ...]]:
    """(context, start, length) of covered ranges; equal contexts are settled by id alone."""
    strings = _gathered(data, at[some], length[some]).dictionary_encode()
    code = strings.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    texts = strings.dictionary
    smallest = np.full(len(texts), NULL_ID)
    np.minimum.at(smallest, code, ids[some])
    later = ids[some] > smallest[code]
    out = [(some[later], np.zeros(int(later.sum()), np.int64), length[some[later]])]
    of_text = np.zeros(len(texts), np.uint32)
    of_text[code] = key[some]
    # Contexts that are alone with their anchor have nothing to be compared with.
    _, number, times = np.unique(of_text, return_inverse=True, return_counts=True)
    pooled = np.flatnonzero(times[number.reshape(-1)] > 1)
    if not len(pooled):
        return out
    pool, offsets = _bytes(texts.take(pa.array(pooled)))
    found = covered(pool, offsets, smallest[pooled], least)
    edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    text = pooled[np.searchsorted(offsets, start, side="right") - 1]
    start_in, windows = start - offsets[np.searchsorted(offsets, start, side="right") - 1], end - start
    # Runs of a text go to all contexts that have it and its smallest id.
    first = np.flatnonzero(~later)
    first = first[np.argsort(code[first], kind="stable")]
    begin, stop = (np.searchsorted(code[first], text, side=s) for s in ("left", "right"))
    run = np.repeat(np.arange(len(text)), stop - begin)
    within = np.arange(len(run)) - np.repeat(np.cumsum(stop - begin) - (stop - begin), stop - begin)
    out.append((some[first[begin[run] + within]], start_in[run], windows[run] + least - 1))
    return out


# --- the documents -----------------------------------------------------------------------------


def _cut(texts: pa.Table, ranges: pa.Table, least: int, keep_bytes: bool) -> pa.Table:
    """Results of a batch of rows."""
    rows = _Rows(texts, ranges)
    held = ranges.filter(pc.is_valid(ranges["idx"]))
    idx, _ = _numbers(held["idx"], np.uint16)
    first, size = (_numbers(held[c], np.int32)[0].astype(np.int64) for c in ("first", "size"))
    row_of = np.zeros(1 << BATCH_BITS, np.int64)
    row_of[rows.number] = np.arange(len(rows.number))
    row = row_of[idx]
    order = np.argsort(row, kind="stable")
    row, first, size = row[order], first[order], size[order]
    columns: list[list] = [[], [], [], [], []]
    for part in slices(rows.column):
        low, high = np.searchsorted(row, [part.first, part.first + part.rows])
        begin = part.offsets[row[low:high] - part.first] + first[low:high]
        n = len(part.data)
        edge = np.bincount(begin, minlength=n + 1) - np.bincount(begin + size[low:high], minlength=n + 1)
        gone = np.cumsum(edge)[:n] > 0
        bytes_of = np.diff(part.offsets)
        whole = rows.copied[part.first : part.first + part.rows] & (bytes_of >= least)
        gone |= np.repeat(whole, bytes_of)
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        begins = part.offsets[:-1][bytes_of > 0]
        opens[begins] = gone[begins]
        removed = part.count(gone)
        kept = memoryview(part.data[~gone])
        ends = np.concatenate([[0], np.cumsum(bytes_of - removed)]).tolist()
        stretch = [kept[a:b] for a, b in zip(ends[:-1], ends[1:])]
        for column, values in zip(columns, (bytes_of, removed, part.count(opens), [hashlib.sha256(x).hexdigest() for x in stretch])):
            column.extend(values)
        if keep_bytes:
            columns[4] += [x.tobytes() for x in stretch]
    arrays = [texts["doc_id"].combine_chunks(), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if keep_bytes:
        arrays, names = [*arrays, pa.array(columns[4], pa.binary())], [*names, "kept"]
    return pa.table(arrays, names=names)


def cleaned(documents: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept: the bytes left] of every document."""
    place = F.monotonically_increasing_id()
    rows = replayable(documents).select(
        F.shiftright(place, BATCH_BITS).alias("batch"),
        place.bitwiseAND(F.lit((1 << BATCH_BITS) - 1)).cast("int").alias("idx"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_ID)).alias("id_order"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(BUCKET_BITS[1], max(BUCKET_BITS[0], (size // BUCKET_BYTES).bit_length()))

    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    prints = rows.filter(F.octet_length("text") >= least).select("batch", "idx", "id_order", digest)
    firsts = prints.groupBy("digest").agg(F.min("id_order").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = prints.join(firsts.select("digest", "first"), "digest").filter("id_order > first")
    # At most the rows of a batch.
    copies = materialised(later.groupBy(F.col("batch").alias("of")).agg(F.collect_list("idx").alias("copied")))

    def by_batch(right: DataFrame, function, schema: str) -> DataFrame:
        def run(key: tuple, texts: pa.Table, about: pa.Table) -> pa.Table:
            return function(key[0].as_py(), texts, about)

        return rows.groupBy("batch").cogroup(right.groupBy("of")).applyInArrow(run, schema)

    def by_bucket(left: DataFrame, function, schema: str) -> DataFrame:
        def run(key: tuple, table: pa.Table) -> pa.Table:
            return function(key[0].as_py(), table)

        return left.groupBy("bucket").applyInArrow(run, schema)

    entries = by_batch(copies, lambda batch, texts, about: _entries(_Rows(texts, about), batch, least, bits), ENTRIES)
    answers = by_bucket(entries, lambda _, table: _answers(table), "bucket int, batch long, keys binary, idx binary")
    copied = copies.select(F.col("of").alias("of"), F.col("copied").alias("copied"))

    def beside(answered: DataFrame) -> DataFrame:
        return answered.withColumnRenamed("batch", "of").unionByName(copied, allowMissingColumns=True)

    def cut_contexts(batch: int, texts: pa.Table, about: pa.Table) -> pa.Table:
        return _contexts(_Rows(texts, about), batch, about.filter(pc.is_valid(about["keys"])), least, bits)

    contexts = by_batch(beside(answers), cut_contexts, CONTEXTS)
    ranges = by_bucket(contexts, lambda bucket, table: _marked(bucket, table, least), "batch long, idx binary, first binary, size binary")
    schema = rows.select("doc_id").schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long", False)
    schema = schema.add("kept_sha256", "string", False)
    if keep_bytes:
        schema = schema.add("kept", "binary", False)
    return by_batch(beside(ranges), lambda _, texts, about: _cut(texts, about, least, keep_bytes), schema)
