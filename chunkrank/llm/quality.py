"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

Every document gets five counts (numpy, whole texts). Repeated words are bounded by the base already. A document without base failure feeds its
ratios into sketches: histograms over logarithmic buckets, which bound the relative error of every
quantile and merge by adding counts. The quantiles of a (language, source) cell are those of its own
sketch and that of its language, which counts as ``LEAST_DOCUMENTS`` documents; so does the sketch of all
documents in that of a language, except for the word length, which differs between languages. A cell
thus has fences at every size, and they move from its language's to its own as it grows. A ratio beyond the fence
``median + reach * (upper quartile - median)`` (and at least ``slack`` over the median) rejects a
document; the mean word length has a lower fence too.

Defined cases: a null text has no words and fails the base; null languages and sources form a cell of
their own; repeated rows are judged alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkrank.llm.tables import map_batches, materialised, row_column
from chunkrank.llm.words import Texts, keyed, repeated, slices, windows

WINDOW = 8
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Relative width of a sketch bucket.
GAMMA = 1.02
#: The sketch a cell is shrunk towards counts as so many documents: with this many the cell weighs as much.
LEAST_DOCUMENTS = 50


@dataclass(frozen=True)
class Rule:
    """A ratio, how far beyond the quartiles it may go, and the distance that is always allowed."""

    name: str
    reach: float
    slack: float
    both_sides: bool = False
    #: Whether languages are comparable, so that small ones lean on all documents.
    any_language: bool = True


RULES = (
    Rule("symbols_per_word", 6.0, 0.1),
    Rule("dup_lines_per_word", 12.0, 0.05),
    Rule("chars_per_word", 6.0, 1.4, both_sides=True, any_language=False),
)


def _count(texts: Texts) -> list[np.ndarray]:
    rows = texts.rows
    line_row = texts.row_of((lines := texts.lines())[0])
    line_keys = keyed(texts.hashes(*lines), line_row)
    order = np.argsort(line_keys, kind="stable")
    later = order[1:][line_keys[order][1:] == line_keys[order][:-1]]
    at = texts.whole_windows(WINDOW)
    keys = keyed(windows(texts.word_hashes, WINDOW)[at], texts.word_row[at])
    again = at[repeated(keys)]
    cover = np.zeros(len(texts.word_row) + WINDOW, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    covered = np.cumsum(cover)[: len(texts.word_row)] > 0
    return [
        np.diff(texts.first_word),
        texts.word_code_points(),
        texts.count(SYMBOLS[texts.data]),
        np.bincount(line_row[later], minlength=rows),
        np.bincount(texts.word_row[covered], minlength=rows),
    ]


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    parts = [_count(t) for t in slices(batch.column("text"))]
    arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)] or [pa.array([], pa.int64())] * 5
    return pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=["row", *COUNTS])


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of the document), the five counts and ``base_failed``."""
    rows = documents.select(row_column(documents).alias("row"), F.col(text).cast("string").alias("text"))
    schema = rows.select("row").schema
    for name in COUNTS:
        schema = schema.add(name, "long", False)
    few = F.col("n_words") < 20
    return map_batches(rows, _measure, schema).withColumn(
        "base_failed", few | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )


def _ratios() -> dict[str, F.Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines_per_word": F.col("n_dup_lines") / words,
        "chars_per_word": F.col("word_chars") / words,
    }


def _bucket(value: F.Column) -> F.Column:
    """Number of the logarithmic bucket; -1 for zero. Ratios here are zero or over 1e-9."""
    step = F.ceil(F.log(value / F.lit(1e-9)) / F.lit(math.log(GAMMA))).cast("int")
    return F.when(value > 0, F.greatest(step, F.lit(0))).otherwise(-1)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, documents): one sketch per cell, mergeable by addition."""
    fed = counted.filter(~F.col("base_failed"))
    ratio = F.explode(
        F.array(*[F.struct(F.lit(n).alias("rule"), _bucket(v).alias("bucket")) for n, v in _ratios().items()])
    )
    return (
        fed.select("lang", "source", ratio.alias("x"))
        .groupBy("lang", "source", "x.rule", "x.bucket")
        .agg(F.count(F.lit(1)).alias("documents"))
    )


def _middle(bucket: int) -> float:
    """The value whose relative distance to the ends of its bucket is the same."""
    return 0.0 if bucket < 0 else 1e-9 * GAMMA**bucket * 2 / (1 + GAMMA)


Sketch = dict[int, float]


def _leaning(own: Sketch, parent: Sketch) -> Sketch:
    """The sketch with the parent's, scaled to ``LEAST_DOCUMENTS`` documents, added to it."""
    scale = LEAST_DOCUMENTS / sum(parent.values())
    return {b: own.get(b, 0) + scale * parent.get(b, 0) for b in sorted({*own, *parent})}


def _fence(rule: Rule, own: Sketch, of_lang: Sketch, of_all: Sketch) -> tuple[float, float]:
    merged = _leaning(own, _leaning(of_lang, of_all) if rule.any_language else of_lang)
    buckets, upto = list(merged), np.cumsum(list(merged.values()))
    reached = np.searchsorted(upto, upto[-1] * (np.array([0.25, 0.5, 0.75]) - 1e-12))
    low, median, high = (_middle(buckets[i]) for i in reached)
    over = max(rule.reach * (high - median), rule.slack)
    under = max(rule.reach * (median - low), rule.slack)
    return median - under if rule.both_sides else -1.0, median + over


def _fences(batch: pa.RecordBatch) -> pa.RecordBatch:
    rules = {r.name: r for r in RULES}

    def sketch(entries: list[dict]) -> Sketch:
        return {x["bucket"]: x["documents"] for x in entries}

    found = [
        _fence(rules[x["rule"]], *[sketch(x[c]) for c in ("own", "of_lang", "of_all")])
        for x in batch.select(["rule", "own", "of_lang", "of_all"]).to_pylist()
    ]
    ends = [pa.array([x[i] for x in found], pa.float64()) for i in range(2)]
    arrays = [*[batch.column(c) for c in ("lang", "source", "rule")], *ends]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "rule", "from", "to"])


def thresholds(counted: DataFrame) -> DataFrame:
    """(lang, source, fences) for every cell: the fences of all rules as a map rule -> (from, to).

    Cells hold a few rules each, so the table is as long as there are pairs of language and source. The
    sketches of languages have some hundred buckets each and go to every task.
    """
    sketch = materialised(sketches(counted))

    def listed(name: str, *keys: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("documents").alias("documents"))
        return merged.groupBy(*keys, "rule").agg(F.collect_list(F.struct("bucket", "documents")).alias(name))

    own = listed("own", "lang", "source")
    by_lang = listed("of_lang", "lang").select(F.col("lang").alias("lang_"), F.col("rule").alias("rule_"), "of_lang")
    overall = listed("of_all")
    joined = own.join(
        F.broadcast(by_lang), F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("rule") == F.col("rule_"))
    ).join(F.broadcast(overall), "rule")
    schema = own.select("lang", "source", "rule").schema.add("from", "double").add("to", "double")
    rows = map_batches(joined.select("lang", "source", "rule", "own", "of_lang", "of_all"), _fences, schema)
    entries = F.collect_list(F.struct("rule", F.struct("from", "to")))
    return rows.groupBy("lang", "source").agg(F.map_from_entries(entries).alias("fences"))


def judged(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``row``, the counts, ``base_failed`` and ``kept`` for every row of the table.

    Cells that no document without base failure reaches have no thresholds and reject nothing more.
    The texts are counted twice, once for the sketches and once for the verdict, which is cheaper
    than writing them. The table of fences is written first, so that Spark knows its size and only
    moves documents when it is too large to broadcast.
    """
    counted = measured(documents, text).withColumns(
        {"lang": F.col(f"row.`{lang}`"), "source": F.col(f"row.`{source}`")}
    )
    found = materialised(thresholds(counted.select("lang", "source", "base_failed", *COUNTS)))
    fences = found.select(
        F.col("lang").alias("cell_lang"), F.col("source").alias("cell_source"), "fences"
    )
    cell = F.col("lang").eqNullSafe(F.col("cell_lang")) & F.col("source").eqNullSafe(F.col("cell_source"))
    ratios = _ratios()
    outside = F.lit(False)
    for rule in RULES:
        fence = F.element_at(F.col("fences"), F.lit(rule.name))
        outside = outside | F.coalesce(
            (ratios[rule.name] > fence["to"]) | (ratios[rule.name] < fence["from"]), F.lit(False)
        )
    return counted.join(fences, cell, "left").select(
        "row", *COUNTS, "base_failed", (~F.col("base_failed") & ~outside).alias("kept")
    )


def kept_documents(documents: DataFrame) -> DataFrame:
    """The documents the rules keep, with their own columns."""
    return judged(documents).filter("kept").select("row.*")
