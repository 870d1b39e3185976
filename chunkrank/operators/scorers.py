"""Numpy kernels: the scores of some queries against a range of chunks.

A scorer names the columns it reads on both sides. ``load`` packs the queries once per task,
``prepare`` packs an Arrow batch of chunks once, and ``score`` gives a dense
``queries x chunks`` block of float64 for some rows of the batch. ``topk`` keeps those blocks
small; none outlives its use.

``rough`` gives such a block in half the numbers, each off by no more than the query's ``slack``, and
``settled`` the float64 scores of the few cells that can still matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLOCK_CELLS = 4_000_000
QUERY_TOKENS = 16_384  # query tokens in a block of late interaction
COMMON_SHARE = 32  # a term of one query in so many goes through the matrix product
PACK_BYTES = 8_000_000


def _plain(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _offsets(lists: pa.Array) -> np.ndarray:
    """Start of each list in the flattened values, plus the end."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _matrix(vectors: pa.Array) -> np.ndarray:
    values = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    if len(vectors) == 0:
        return np.empty((0, 0))
    if len(values) % len(vectors) or pc.count_distinct(pc.list_value_length(vectors)).as_py() != 1:
        raise ValueError("vectors of different length")
    return values.reshape(len(vectors), -1)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.maximum(norms, 1e-12)[:, None]


@dataclass(frozen=True)
class Rough:
    """Scores in float32, how far each query's may be off, and what the exact ones are made of."""

    scores: np.ndarray
    slack: np.ndarray
    seen: np.ndarray
    cells: np.ndarray
    posting: np.ndarray
    ends: np.ndarray
    gain: np.ndarray


class _Plain:
    """A scorer whose chunks are kept as they come."""

    def width(self, queries) -> int:
        """Numbers that a chunk takes in a block besides its scores."""
        return 1

    def stored(self, chunks: DataFrame) -> DataFrame:
        """The chunks in the form that is written for tasks that read them over and over."""
        return chunks

    def stored_elements(self) -> Column:
        return self.elements()

    def rough(self, queries, chunks, start: int, stop: int) -> Rough | None:
        """A block of float32, or None where only ``score`` will do."""
        return None

    def settled(self, queries, rough: Rough, wanted: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The scores of the cells of a rough block that are marked as wanted."""
        raise NotImplementedError


class Dense(_Plain):
    """Raw dot product of one vector per side."""

    query_columns = ("vector",)
    chunk_columns = ("vector",)

    def elements(self) -> Column:
        return F.size("vector")

    query_elements = elements

    def load(self, queries: pa.Table) -> np.ndarray:
        return _matrix(_plain(queries["vector"]))

    def prepare(self, queries: np.ndarray, batch: pa.Table) -> np.ndarray:
        chunks = _matrix(_plain(batch["vector"]))
        if queries.shape[1] != chunks.shape[1]:
            raise ValueError("query and chunk vectors differ in length")
        return chunks

    def score(self, queries: np.ndarray, chunks: np.ndarray, start: int, stop: int) -> np.ndarray:
        return queries @ chunks[start:stop].T


class MaxSim(_Plain):
    """Late interaction: sum over query tokens of the best cosine among the chunk's tokens.

    With ``pad_floor`` the chunk rows carry ``padded``: a chunk shorter than the longest one
    was filled up with zero vectors, so each of its maxima is at least 0.
    """

    query_columns = ("token_vectors",)

    def __init__(self, pad_floor: bool = False):
        self.pad_floor = pad_floor
        self.chunk_columns = ("token_vectors", "padded") if pad_floor else ("token_vectors",)

    def elements(self) -> Column:
        return F.size("token_vectors") * F.coalesce(F.size(F.try_element_at("token_vectors", F.lit(1))), F.lit(1))

    query_elements = elements

    @staticmethod
    def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
        matrices = _plain(column)
        offsets = _offsets(matrices)
        if (np.diff(offsets) == 0).any():
            raise ValueError("a text without tokens has no token vectors")
        return _unit_rows(_matrix(pc.list_flatten(matrices))), offsets

    def load(self, queries: pa.Table):
        return self._tokens(queries["token_vectors"])

    def prepare(self, queries, batch: pa.Table):
        padded = batch["padded"].to_numpy().astype(bool) if self.pad_floor else None
        return *self._tokens(batch["token_vectors"]), padded

    def score(self, queries, chunks, start: int, stop: int) -> np.ndarray:
        query_tokens, query_at = queries
        chunk_tokens, chunk_at, padded = chunks
        scores = np.empty((len(query_at) - 1, stop - start))
        # Whole queries at a time, then whole chunks, or stretches of one that is too long: at no
        # time are there more than a block of (query token, chunk token) cells.
        first = 0
        while first < len(query_at) - 1:
            last = int(np.searchsorted(query_at, query_at[first] + QUERY_TOKENS, side="right")) - 1
            last = min(max(last, first + 1), len(query_at) - 1)
            own = query_tokens[query_at[first] : query_at[last]]
            room = max(1, BLOCK_CELLS // len(own))
            low = start
            while low < stop:
                high = int(np.searchsorted(chunk_at, chunk_at[low] + room, side="right")) - 1
                high = min(max(high, low + 1), stop)
                best = self._best(own, chunk_tokens, chunk_at[low : high + 1], room)
                if padded is not None:
                    short = padded[low:high]
                    best[:, short] = np.maximum(best[:, short], 0.0)
                at = query_at[first:last] - query_at[first]
                scores[first:last, low - start : high - start] = np.add.reduceat(best, at, axis=0)
                low = high
            first = last
        return scores

    @staticmethod
    def _best(own: np.ndarray, chunk_tokens: np.ndarray, at: np.ndarray, room: int) -> np.ndarray:
        """Best cosine of every query token in every chunk; one long chunk goes by stretches."""
        if len(at) > 2 or at[1] - at[0] <= room:
            return np.maximum.reduceat(own @ chunk_tokens[at[0] : at[-1]].T, at[:-1] - at[0], axis=1)
        best = np.full((len(own), 1), -np.inf)
        for begin in range(at[0], at[1], room):
            part = chunk_tokens[begin : min(begin + room, at[1])]
            best = np.maximum(best, (own @ part.T).max(axis=1, keepdims=True))
        return best


class Bm25(_Plain):
    """Okapi BM25 over the chunk's own tokens.

    Everything that depends on the whole corpus (idf and the mean length) arrives with the
    query: ``terms`` with ``weights`` = occurrences x idf, and ``avgdl``. So the corpus is
    scored where it lies. Terms that many queries share go through one matrix product; the
    others through their short lists of queries.
    """

    query_columns = ("terms", "weights", "avgdl")
    chunk_columns = ("tokens",)

    def __init__(self, k1: float = 1.5, b: float = 0.75):
        self.k1 = k1
        self.b = b

    def elements(self) -> Column:
        return F.size("tokens")

    def query_elements(self) -> Column:
        return F.size("terms")

    def load(self, queries: pa.Table) -> dict:
        terms = _plain(queries["terms"])
        count = len(terms)
        weights = pc.list_flatten(_plain(queries["weights"])).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(count), np.diff(_offsets(terms)))
        coded = pc.list_flatten(terms).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        spread = np.bincount(code, minlength=len(coded.dictionary))
        common = spread > max(8, count // COMMON_SHARE)

        dense_no = np.cumsum(common) - 1
        dense = np.zeros((count, int(common.sum())))
        shared = common[code]
        dense[owner[shared], dense_no[code[shared]]] = weights[shared]

        order = np.argsort(code[~shared], kind="stable")
        # Each of a query's terms adds one product and one sum in float32, whatever their order.
        steps = np.diff(_offsets(terms)) + 16
        rounding = steps * np.finfo(np.float32).eps * np.bincount(owner, np.abs(weights), minlength=count)
        return {
            "count": count,
            "vocabulary": coded.dictionary,
            "avgdl": queries["avgdl"][0].as_py(),
            "common": common,
            "dense_no": dense_no,
            "dense": dense,
            "starts": np.concatenate([[0], np.cumsum(np.where(common, 0, spread))]),
            "owner": owner[~shared][order],
            "weights": weights[~shared][order],
            "dense_rough": dense.astype(np.float32),
            "weights_rough": weights[~shared][order].astype(np.float32),
            "rounding": rounding,
        }

    def width(self, queries: dict) -> int:
        return queries["dense"].shape[1]

    def stored(self, chunks: DataFrame) -> DataFrame:
        """The distinct terms of each chunk with their counts, and its length."""
        kept = [c for c in chunks.columns if c != "tokens"]
        schema = T.StructType(
            [
                *[chunks.schema[c] for c in kept],
                T.StructField("terms", T.ArrayType(T.StringType())),
                T.StructField("counts", T.ArrayType(T.IntegerType())),
                T.StructField("length", T.IntegerType()),
            ]
        )
        arrow = to_arrow_schema(schema)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                each = max(1, batch.num_rows * PACK_BYTES // max(batch.nbytes, 1))
                for start in range(0, batch.num_rows, each):
                    some = batch.slice(start, each)
                    lengths, doc, code, counts, terms = counted(some["tokens"])
                    offsets = pa.array(np.searchsorted(doc, np.arange(len(some) + 1)), pa.int32())
                    columns = [
                        *[some[c] for c in kept],
                        pa.ListArray.from_arrays(offsets, terms.take(pa.array(code))),
                        pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                        pa.array(lengths, pa.int32()),
                    ]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
                batch = some = columns = None
                pa.default_memory_pool().release_unused()

        return chunks.mapInArrow(pack, schema)

    def stored_elements(self) -> Column:
        return F.size("terms")

    def prepare(self, queries: dict, batch: pa.Table):
        """Per chunk its length and, as (chunk, term, gain) rows, the terms any query asks for."""
        if "counts" in batch.column_names:
            lists = _plain(batch["terms"])
            lengths = batch["length"].to_numpy()
            doc, code, known = self._asked(queries, lists)
            tf = pc.list_flatten(_plain(batch["counts"])).to_numpy(zero_copy_only=False)[known]
        else:
            lists = _plain(batch["tokens"])
            lengths = np.diff(_offsets(lists))
            doc, code, _ = self._asked(queries, lists)
            size = max(len(queries["vocabulary"]), 1)
            pair, tf = np.unique(doc * size + code, return_counts=True)
            doc, code = pair // size, pair % size
        norm = self.k1 * (1 - self.b + self.b * lengths[doc] / queries["avgdl"])
        return doc, code, tf * (self.k1 + 1) / (tf + norm)

    @staticmethod
    def _asked(queries: dict, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, term) of the elements that any query asks for, and which of all elements these are."""
        found = pc.index_in(pc.list_flatten(lists), value_set=queries["vocabulary"])
        known = pc.is_valid(found).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lists)), np.diff(_offsets(lists)))[known]
        return doc, pc.drop_null(found).to_numpy(zero_copy_only=False), known

    def _block(self, queries: dict, chunks, start: int, stop: int):
        """What common terms add, by chunk; then chunk, gain, first query and queries of each other term."""
        doc, code, gain = chunks
        mine = slice(*np.searchsorted(doc, [start, stop]))
        doc, code, gain = doc[mine] - start, code[mine], gain[mine]
        shared = queries["common"][code]
        seen = np.zeros((stop - start, queries["dense"].shape[1]))
        seen[doc[shared], queries["dense_no"][code[shared]]] = gain[shared]
        doc, code, gain = doc[~shared], code[~shared], gain[~shared]
        first = queries["starts"][code]
        return seen, doc, gain, first, queries["starts"][code + 1] - first

    @staticmethod
    def _postings(queries: dict, doc: np.ndarray, first: np.ndarray, n: np.ndarray, width: int):
        """Places in the lists of queries, and the cells of the block that they add to."""
        posting = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return posting, queries["owner"][posting] * width + np.repeat(doc, n)

    def score(self, queries: dict, chunks, start: int, stop: int) -> np.ndarray:
        seen, doc, gain, first, fan = self._block(queries, chunks, start, stop)
        scores = queries["dense"] @ seen.T
        ends = np.cumsum(fan)
        low = 0
        while low < len(doc):
            base = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, base + BLOCK_CELLS, side="right")))
            n = fan[low:high]
            posting, cell = self._postings(queries, doc[low:high], first[low:high], n, stop - start)
            np.add.at(scores.reshape(-1), cell, np.repeat(gain[low:high], n) * queries["weights"][posting])
            low = high
        return scores

    def rough(self, queries: dict, chunks, start: int, stop: int) -> Rough | None:
        seen, doc, gain, first, fan = self._block(queries, chunks, start, stop)
        ends = np.cumsum(fan)
        if len(ends) and ends[-1] > BLOCK_CELLS:
            return None
        scores = queries["dense_rough"] @ seen.astype(np.float32).T
        posting, cell = self._postings(queries, doc, first, fan, stop - start)
        np.add.at(scores.reshape(-1), cell, np.repeat(gain.astype(np.float32), fan) * queries["weights_rough"][posting])
        most = max(np.abs(gain).max(initial=0), np.abs(seen).max(initial=0))
        return Rough(scores, queries["rounding"] * most, seen, cell, posting, ends, gain)

    def settled(self, queries: dict, rough: Rough, wanted: np.ndarray, cells: np.ndarray) -> np.ndarray:
        query, column = np.divmod(cells, rough.scores.shape[1])
        scores = np.empty(len(cells))
        each = max(1, BLOCK_CELLS // max(1, rough.seen.shape[1]))
        for i in range(0, len(cells), each):
            some = slice(i, i + each)
            np.einsum("ij,ij->i", queries["dense"][query[some]], rough.seen[column[some]], out=scores[some])
        mine = np.flatnonzero(wanted.ravel()[rough.cells])
        added = rough.gain[np.searchsorted(rough.ends, mine, side="right")] * queries["weights"][rough.posting[mine]]
        place = np.empty(wanted.size, dtype=np.int32)
        place[cells] = np.arange(len(cells))
        return scores + np.bincount(place[rough.cells[mine]], added, minlength=len(cells))


def counted(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Lengths of token lists, then (list, term, count) rows by list, and the terms that these number."""
    lengths = np.diff(_offsets(lists))
    tokens = pc.list_flatten(lists)
    known = pc.is_valid(tokens).to_numpy(zero_copy_only=False)
    coded = pc.drop_null(tokens).dictionary_encode()
    size = max(len(coded.dictionary), 1)
    lists_of = np.repeat(np.arange(len(lists)), lengths)[known]
    pair, counts = np.unique(lists_of * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return lengths, pair // size, pair % size, counts, coded.dictionary
