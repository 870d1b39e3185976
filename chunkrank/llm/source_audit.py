"""How far the sources of a language are from each other, and the words that set one apart.

Words are strings of any length, so they stay where they were read as long as possible:

1. A first pass shuffles only (digest, documents), combined within batches and tasks, to find the
   digests (64 bits of the term and its language) with enough documents.
2. A second pass counts those digests per (language, source), again as numbers. Beside the counts it
   names the strings it met, each once a batch. Of a digest's strings only the smallest and the largest
   are gathered. Where the two differ, terms collide: such a digest is split, its terms are told apart
   by their strings from then on, and each has to have enough documents of its own.
3. Counts per source and term meet as numbers. Shares are whole billionths, by long division in three
   steps of a thousand, so nothing is rounded and nothing overflows below 9e15 occurrences.
4. Pairs of sources: terms are dealt into shares of bounded size, and sources into blocks, so a task
   holds the terms of one share as a matrix of two blocks at most. A term that neither source has
   counts by two numbers of the sources alone, so absent terms make no rows.
5. Distinctive terms: the best ranks (with all that tie) are chosen by number; their text is joined
   back, and settles the ties.

Defined cases: null texts, languages and sources are empty strings; a text without terms still names
its source; a language that keeps no term has pairs of value 0 and no terms. Very long texts and terms
are read whole; repeated rows are documents of their own; an empty table gives an empty result. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkrank.llm.runs import byte_class, coded, runs
from chunkrank.llm.tables import map_batches, materialised
from chunkrank.llm.words import Texts, keyed, slices

LEAST_DOCUMENTS = 10
TOP = 10
UNIT = 1_000_000_000
#: Letters A to Z and a to z and everything beyond ASCII; only A to Z change case.
IN_TERM = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 0x20

#: Rows of (source, term) in a share of terms, and sources in a block.
SHARE_ROWS = 100_000
BLOCK = 256
#: Digests that every task gets as numbers, 8 bytes each; more than these meet by a shuffle.
SENT_DIGESTS = 1_000_000
#: Text that a task counts at a time, within an Arrow batch.
PART_BYTES = 4 << 20
TERM = ("lang", "digest", "split")


def _summed(keys: tuple[np.ndarray, ...], numbers: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Adds up the numbers of equal keys."""
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return [k[first] for k in keys], [np.add.reduceat(n[order], first) if len(first) else n for n in numbers]


class _Cells:
    """The languages and sources of an Arrow batch, and the (language, source) cell of every row."""

    def __init__(self, batch: pa.RecordBatch):
        lang, source = (batch.column(n).dictionary_encode() for n in ("lang", "source"))
        self.langs, self.sources = lang.dictionary, source.dictionary
        self.many = max(1, len(self.sources))
        self.of_row = lang.indices.to_numpy().astype(np.int64) * self.many + source.indices.to_numpy()
        name = _texts(self.langs.cast(pa.large_string()))
        self.hashes = name.hashes(name.offsets[:-1], name.offsets[1:])

    def lang(self, cell: np.ndarray) -> pa.Array:
        return self.langs.take(pa.array(cell // self.many))

    def source(self, cell: np.ndarray) -> pa.Array:
        return self.sources.take(pa.array(cell % self.many))


def _counted(texts: Texts, cells: _Cells, digest_bits: int, wanted: np.ndarray | None) -> tuple[pa.Array, list[np.ndarray]]:
    """Of a slice: the terms, and per distinct (term, cell) term number, cell, digest, occurrences, documents."""
    found, row = runs(LOWERED[texts.data], texts.offsets, IN_TERM[texts.data])
    codes, terms = coded(found)
    size = max(1, len(terms))
    each, occurrences = np.unique(row * size + codes, return_counts=True)
    cell = cells.of_row[texts.first + each // size]
    (term, cell), numbers = _summed((each % size, cell), (occurrences, np.ones(len(each), np.int64)))
    own = _texts(terms)
    digest = keyed(own.hashes(own.offsets[:-1], own.offsets[1:])[term], cells.hashes[cell // cells.many])
    columns = [term, cell, (digest >> np.uint64(64 - digest_bits)).view(np.int64), *numbers]
    if wanted is not None:
        at = np.searchsorted(wanted, columns[2])
        held = np.zeros(len(term), dtype=bool)
        held[at < len(wanted)] = wanted[at[at < len(wanted)]] == columns[2][at < len(wanted)]
        columns = [c[held] for c in columns]
    return terms, columns


def _parts(column: pa.Array) -> Iterator[list[Texts]]:
    """The slices of a batch, some megabytes of them at a time."""
    part, size = [], 0
    for texts in slices(column):
        part.append(texts)
        size += len(texts.data)
        if size >= PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _texts(strings: pa.Array) -> Texts:
    """Strings as bytes and offsets, for their hashes."""
    return next(slices(strings, 1 << 62), Texts(0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))


def _cleaned(documents: DataFrame, columns: tuple[str, str, str]) -> DataFrame:
    return documents.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in zip(columns, ("text", "lang", "source"))]
    )


def frequent_digests(rows: DataFrame, least: int, digest_bits: int = 64) -> DataFrame:
    """(digest) of terms in ``least`` documents of a language; the digest depends on the language too.

    Only digests and numbers are shuffled, combined by batch and by task before.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = _Cells(batch)
        digests, documents = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in _parts(batch.column("text")):
            found = [_counted(texts, cells, digest_bits, None)[1] for texts in part]
            (digest,), (n,) = _summed((np.concatenate([f[2] for f in found]),), (np.concatenate([f[4] for f in found]),))
            digests.append(digest)
            documents.append(n)
        (digest,), (n,) = _summed((np.concatenate(digests),), (np.concatenate(documents),))
        return pa.RecordBatch.from_arrays([pa.array(digest), pa.array(n)], names=["digest", "documents"])

    each = map_batches(rows, count, "digest long, documents long")
    return materialised(each.groupBy("digest").agg(F.sum("documents").alias("n")).filter(F.col("n") >= least).select("digest"))


def counted_terms(rows: DataFrame, digests: DataFrame, digest_bits: int = 64, by_text: bool = False) -> DataFrame:
    """Counts of the terms behind ``digests``, combined by batch: (lang, source, digest, term, n, documents).

    ``term`` is null in these rows; further rows, without a source, have the strings of a digest, each
    once a batch. ``by_text`` counts every string of a digest by itself instead.
    """
    few = digests.count() <= SENT_DIGESTS
    # At most SENT_DIGESTS numbers, counted just before.
    sent = rows.sparkSession.sparkContext.broadcast(np.sort(digests.toArrow()["digest"].to_numpy())) if few else None

    names = ["lang", "source", "digest", "term", "n", "documents"]

    def rows_of(cells: _Cells, cell: np.ndarray, source: pa.Array, digest: np.ndarray, term: pa.Array, *numbers: np.ndarray) -> pa.RecordBatch:
        arrays = [cells.lang(cell), source, pa.array(digest), term.cast(pa.string()), *map(pa.array, numbers)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _Cells(batch)
            strings, digests, langs = [pa.array([], pa.large_string())], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in _parts(batch.column("text")):
                found = [_counted(texts, cells, digest_bits, sent.value if few else None) for texts in part]
                if by_text:
                    for terms, (term, cell, digest, *numbers) in found:
                        yield rows_of(cells, cell, cells.source(cell), digest, terms.take(pa.array(term)), *numbers)
                    continue
                cell, digest, n, documents = (np.concatenate([f[1][i] for f in found]) for i in range(1, 5))
                (digest, cell), numbers = _summed((digest, cell), (n, documents))
                yield rows_of(cells, cell, cells.source(cell), digest, pa.nulls(len(cell), pa.string()), *numbers)
                for terms, (term, cell, digest, *_) in found:
                    # A string once for each language, whatever its sources.
                    (term, digest, lang), _ = _summed((term, digest, cell // cells.many), ())
                    strings.append(terms.take(pa.array(term)))
                    digests.append(digest)
                    langs.append(lang)
                strings, digests, langs = _distinct(strings, digests, langs)
            if not by_text:
                none = np.zeros(len(digests[0]), np.int64)
                yield rows_of(cells, langs[0] * cells.many, pa.nulls(len(none), pa.string()), digests[0], strings[0], none, none)

    schema = "lang string, source string, digest long, term string, n long, documents long"
    counted = rows.mapInArrow(count, schema)
    return materialised(counted if few else counted.join(digests, "digest", "left_semi").select(*counted.columns))


def _distinct(strings: list[pa.Array], digests: list[np.ndarray], langs: list[np.ndarray]) -> tuple[list[pa.Array], list[np.ndarray], list[np.ndarray]]:
    code, named = coded(pa.concat_arrays(strings))
    (code, digest, lang), _ = _summed((code, np.concatenate(digests), np.concatenate(langs)), ())
    return [named.take(pa.array(code))], [digest], [lang]


def kept_terms(rows: DataFrame, least: int = LEAST_DOCUMENTS, digest_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Of the terms in ``least`` documents of their language: counts per source, and texts.

    Counts: (lang, source, digest, split, n, total). ``split`` is the term itself where its digest
    stands for several, else empty. Texts: (lang, digest, low), with the text of unsplit digests.
    """
    often = frequent_digests(rows, least, digest_bits)
    found = counted_terms(rows, often, digest_bits)
    named = found.filter("source is null").groupBy("lang", "digest")
    texts = materialised(named.agg(F.min("term").alias("low"), F.max("term").alias("high")))
    collided = texts.filter("low <> high").select("digest").distinct()
    counts = found.filter("source is not null").select("lang", "source", "digest", F.lit("").alias("split"), "n", "documents")
    if not collided.isEmpty():
        collided = materialised(collided)
        split = counted_terms(rows, collided, digest_bits, by_text=True).withColumnRenamed("term", "split")
        counts = counts.join(collided, "digest", "left_anti").unionByName(split)
    each = materialised(
        counts.groupBy("lang", "digest", "split", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    )
    totals = each.groupBy(*TERM).agg(F.sum("n").alias("total"), F.sum("documents").alias("documents")).filter(F.col("documents") >= least)
    return materialised(each.drop("documents").join(totals.drop("documents"), list(TERM))), texts.select("lang", "digest", "low")


def groups(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Every (lang, source): source_no, sources, n_source, n_lang and terms of the language."""
    found = rows.select("lang", "source").distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    terms = counts.groupBy(*TERM).agg(F.first("total").alias("total"))
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("n_lang"))
    zero = F.lit(0).cast("long")
    by_name = Window.partitionBy("lang").orderBy("source")
    return materialised(
        found.join(own, ["lang", "source"], "left")
        # One row per language, the languages of the table at most.
        .join(of_lang, "lang", "left")
        .select(
            "lang",
            "source",
            *[F.coalesce(c, zero).alias(c) for c in ("n_source", "n_lang", "terms")],
            (F.row_number().over(by_name) - 1).alias("source_no"),
            F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("sources"),
        )
    )


def share(count: Column, n: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (n + 2 * terms)) in whole numbers."""
    below = n + F.lit(2) * terms
    rest, out = count + F.lit(2), F.lit(0).cast("long")
    for _ in range(3):
        scaled = rest * F.lit(1000)
        out = out * F.lit(1000) + F.call_function("div", scaled, below)
        rest = scaled % below
    return out + F.lit(1)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    rest, out = count + 2, np.zeros(np.broadcast_shapes(count.shape, below.shape), np.int64)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + step
    return out + 1


def _pair_sums(source: np.ndarray, term: np.ndarray, n: np.ndarray, own: np.ndarray, below: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
    """Sums of f over the terms, less what f would be if neither source had them, for all pairs."""
    out = np.zeros((len(own), len(own)), np.int64)
    absent = _shares(np.zeros(1, np.int64), below)
    base = (absent[:, None] - absent[None, :]) ** 2 // (absent[:, None] + absent[None, :])
    order = np.argsort(term, kind="stable")
    source, term, n = np.searchsorted(own, source[order]), term[order], n[order]
    step = max(1, cells // max(1, len(own) ** 2))
    many = int(term[-1]) + 1 if len(term) else 0
    for first in range(0, many, step):
        last = min(first + step, many)
        a, b = np.searchsorted(term, [first, last])
        count = np.zeros((last - first, len(own)), np.int64)
        count[term[a:b] - first, source[a:b]] = n[a:b]
        p = _shares(count, below)
        for i in range(len(own)):
            mine = p[:, i : i + 1]
            out[i] += ((mine - p) ** 2 // (mine + p) - base[i]).sum(axis=0)
    return out


def pair_values(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, a, b, value) for every two source numbers a < b of a language."""
    shares = max(1, counts.count() // SHARE_ROWS)
    blocks = F.ceil(F.col("sources") / F.lit(BLOCK)).cast("int")
    mine = F.floor(F.col("source_no") / F.lit(BLOCK)).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    key = ["lang", "low", "high", "share"]
    two = [F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")]
    placed = cells.select("*", mine.alias("mine"), other)
    sides = placed.select("lang", *two, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "source_no", "n_source", "terms")
    # Both sides come from one table; new names keep their columns apart.
    sides = sides.select(*[F.col(c).alias(c) for c in sides.columns])
    rows = counts.join(placed.select("lang", "source", "source_no", *two), ["lang", "source"]).select(
        "lang", "low", "high", F.pmod(F.xxhash64("digest", "split"), F.lit(shares)).cast("int").alias("share"), "source_no", "digest", "split", "n"
    )

    def summed(key: tuple, counted: pa.Table, about: pa.Table) -> pa.Table:
        at = pc.sort_indices(about["source_no"])
        own, n_source, terms = (about[c].take(at).to_numpy().astype(np.int64) for c in ("source_no", "n_source", "terms"))
        lang, low, high, number = (k.as_py() for k in key)
        below = n_source + 2 * terms
        values = np.zeros((len(own), len(own)), np.int64)
        if len(own) and terms[0]:
            values = _pair_sums(counted["source_no"].to_numpy().astype(np.int64), _numbered(counted), counted["n"].to_numpy(), own, below)
            if number == 0:
                absent = _shares(np.zeros(1, np.int64), below)
                values += terms[0] * ((absent[:, None] - absent[None, :]) ** 2 // (absent[:, None] + absent[None, :]))
        a, b = np.nonzero(own[:, None] < own[None, :])
        # Two sources of one block meet in every pair of blocks that has it: they count in its own.
        block = own // BLOCK
        proper = (np.minimum(block[a], block[b]) == low) & (np.maximum(block[a], block[b]) == high)
        a, b = a[proper], b[proper]
        numbers = [pa.array(x.astype(np.int64)) for x in (own[a], own[b], values[a, b])]
        return pa.table([pa.array([lang] * len(a), pa.string()), *numbers], names=["lang", "a", "b", "value"])

    parts = rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(summed, "lang string, a long, b long, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _numbered(counted: pa.Table) -> np.ndarray:
    """Terms as numbers 0, 1, …"""
    digest = np.unique(counted["digest"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    split, names = coded(counted["split"].combine_chunks().cast(pa.large_string()))
    return np.unique(digest * max(1, len(names)) + split, return_inverse=True)[1].astype(np.int64)


def audited(
    documents: DataFrame,
    least: int = LEAST_DOCUMENTS,
    top: int = TOP,
    columns: tuple[str, str, str] = ("text", "lang", "source"),
    digest_bits: int = 64,
) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for all other sources, ``term`` rows to ``top``."""
    rows = _cleaned(documents, columns)
    counts, texts = kept_terms(rows, least, digest_bits)
    cells = groups(rows, counts)

    each = pair_values(counts, cells)
    ends = F.inline(F.array(*[F.struct(F.col(x).alias("mine"), F.col(y).alias("other"), "value") for x, y in ("ab", "ba")]))
    name = [cells.select("lang", F.col("source_no").alias(n), F.col("source").alias(c)) for n, c in (("mine", "source"), ("other", "item"))]
    pairs = each.select("lang", ends).join(name[0], ["lang", "mine"]).join(name[1], ["lang", "other"])
    within = Window.partitionBy("lang", "source")
    order = within.orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    known = counts.filter("n > 0").join(cells, ["lang", "source"])
    p, q = share(F.col("n"), F.col("n_source"), F.col("terms")), share(F.col("total"), F.col("n_lang"), F.col("terms"))
    above = known.select("lang", "source", "digest", "split", p.alias("p"), q.alias("q")).filter("p > q")
    valued = above.select("lang", "source", "digest", "split", divergence(F.col("p"), F.col("q")).alias("value"))
    best = valued.withColumn("place", F.rank().over(within.orderBy(F.desc("value")))).filter(F.col("place") <= top)
    item = F.when(F.col("split") == "", F.col("low")).otherwise(F.col("split")).alias("item")
    named = best.join(texts, ["lang", "digest"]).select("lang", "source", F.lit("term").alias("part"), item, "value")
    terms = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
