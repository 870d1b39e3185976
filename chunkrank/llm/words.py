"""Words, lines and their 64-bit hashes for whole Arrow batches at once.

White space is ``[\\x20\\x09-\\x0D]``, ASCII only, so UTF-8 bytes can be scanned as they are. The
hash of any byte range comes from one running polynomial modulo 2**64, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = 0x0A

#: A slice holds whole texts of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, kept for the next slice."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(values: np.ndarray, key: np.ndarray | int) -> np.ndarray:
    """Hash pairs, e.g. of a hash and the number of its text."""
    return mix(values ^ mix(np.atleast_1d(np.asarray(key, dtype=np.uint64)) + np.uint64(_STEP)))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries."""
    n = max(0, len(hashes) - k + 1)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = total * np.uint64(_STEP) + hashes[j : j + n]
    return mix(total)


@dataclass
class Texts:
    """Some rows of a batch: UTF-8 bytes, and where each row begins in them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def _word(self) -> np.ndarray:
        return ~WHITE[self.data]

    @cached_property
    def _begins(self) -> np.ndarray:
        begins = np.zeros(len(self.data) + 1, dtype=bool)
        begins[self.offsets] = True
        return begins

    @cached_property
    def _running(self) -> np.ndarray:
        n = len(self.data)
        running = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n), out=running[1:])
        return running

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = _power_table(pow(_BASE, -1, 1 << 64), len(self.data) + 1)
        raw = (self._running[ends] - self._running[starts]) * inverse[starts]
        return keyed(raw, ends - starts)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word."""
        word = self._word
        after = np.ones(len(word), dtype=bool)
        after[1:] = ~word[:-1]
        before = np.ones(len(word), dtype=bool)
        before[:-1] = ~word[1:]
        starts = np.flatnonzero(word & (after | self._begins[:-1]))
        ends = np.flatnonzero(word & (before | self._begins[1:])) + 1
        return starts, ends

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.hashes(*self.words)

    @cached_property
    def word_row(self) -> np.ndarray:
        """The row of every word."""
        return self.row_of(self.words[0])

    @cached_property
    def first_word(self) -> np.ndarray:
        """Number of the first word of every row, and of all words at the end."""
        return np.searchsorted(self.words[0], self.offsets)

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def whole_windows(self, k: int) -> np.ndarray:
        """Numbers of the words that begin k words of one row."""
        rows = self.word_row
        n = max(0, len(rows) - k + 1)
        return np.flatnonzero(rows[:n] == rows[k - 1 :][:n])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the \\n-split lines that hold a word."""
        cut = self.data == NEWLINE
        begins = self._begins.copy()
        begins[1:] |= cut
        starts = np.flatnonzero(begins[:-1])
        ends = np.append(starts[1:], len(self.data))
        if len(starts):
            ends = ends - cut[ends - 1]
        count = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(self._word, out=count[1:])
        held = count[ends] > count[starts]
        return starts[held], ends[held]

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        running = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=running[1:])
        return running[self.offsets[1:]] - running[self.offsets[:-1]]

    def code_points(self) -> np.ndarray:
        return self.count((self.data & 0xC0) != 0x80)

    def word_code_points(self) -> np.ndarray:
        return self.count(((self.data & 0xC0) != 0x80) & self._word)


def slices(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a column of texts (null: empty) into slices of whole rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + slice_bytes, side="right")) - 1
        end = min(len(column), max(end, row + 1))
        yield Texts(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive entries, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:]) if len(values) > size else values[:0]
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest and len(values) > rest else values[: len(values) - rest]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out
