"""BM25 Okapi as two passes over the corpus: document frequencies, then scores.

Only (term, count) pairs are shuffled, after combining in each batch and task, so a word found in every
document costs one row per task. The second pass scores each chunk where it is read; see
``scorers.Bm25`` for why no term join is needed and why chunks sharing no word with a query
still appear, with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkrank.functions.text import tokens
from chunkrank.operators.scorers import counted
from chunkrank.schema import one_per_dataset
from chunkrank.session import materialised

# The usual Okapi parameters.
K1 = 1.5
B = 0.75
EPSILON = 0.25

COUNT_BYTES = 16_000_000  # of the tokens whose terms are counted at once


def tokenised(rows: DataFrame, sentinels: Sequence[str] = ()) -> DataFrame:
    """Adds ``tokens`` unless the caller supplied them (from another tokenizer)."""
    if "tokens" in rows.columns:
        return rows
    return rows.withColumn("tokens", tokens(F.col("text"), sentinels))


def term_counts(corpus: DataFrame) -> DataFrame:
    """The index: chunks holding each term, from one pass over the texts, written once.

    The null term stands for the chunk itself: its row holds the number of chunks and, in
    ``total``, their summed length. A supplied empty token is a term like any other.
    Terms are counted a batch at a time, so that a row leaves for each of a batch's terms and not for each chunk's.
    """
    schema = T.StructType(
        [
            corpus.schema["dataset"],
            T.StructField("term", T.StringType()),
            T.StructField("df", T.LongType()),
            T.StructField("total", T.LongType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = max(1, batch.num_rows * COUNT_BYTES // max(batch.nbytes, 1))
            for start in range(0, batch.num_rows, each):
                some = batch.slice(start, each)
                some = some.filter(pc.is_valid(some["tokens"]))
                if some.num_rows:
                    yield _counts_of(some, arrow)
            batch = some = None
            pa.default_memory_pool().release_unused()

    counts = (
        corpus.select("dataset", "tokens")
        .mapInArrow(count, schema)
        .groupBy("dataset", "term")
        .agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    )
    return materialised(counts)


def _counts_of(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """(dataset, term, chunks, their length) of some chunks, with the null term of each data set."""
    lengths, doc, code, _, terms = counted(batch["tokens"])
    sets = batch["dataset"].dictionary_encode(null_encoding="encode")
    own = sets.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(terms) + 1
    # The number after the last term is the null term.
    key = np.concatenate([own[doc] * size + code, own * size + len(terms)])
    length = np.concatenate([lengths[doc], lengths])
    most = len(sets.dictionary) * size
    df, total = np.bincount(key, minlength=most), np.bincount(key, length, minlength=most)
    found = np.flatnonzero(df)
    of, term = np.divmod(found, size)
    columns = [
        sets.dictionary.take(pa.array(of)),
        terms.take(pa.array(term, mask=term == len(terms))),
        pa.array(df[found], pa.int64()),
        pa.array(total[found].astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def corpus_size(counts: DataFrame) -> DataFrame:
    return counts.filter("term is null").select(
        "dataset", F.col("df").alias("chunks"), (F.col("total") / F.col("df")).alias("avgdl")
    )


def term_weights(counts: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Per term: document frequency and idf, negative idf lifted to epsilon x mean idf."""
    raw = (
        counts.filter("term is not null")
        .join(one_per_dataset(corpus_size(counts)), "dataset")
        .withColumn("raw_idf", F.log(F.col("chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    )
    mean = raw.groupBy("dataset").agg(F.avg("raw_idf").alias("mean_idf"))
    lifted = F.when(F.col("raw_idf") < 0, F.lit(epsilon) * F.col("mean_idf")).otherwise(F.col("raw_idf"))
    return raw.join(one_per_dataset(mean), "dataset").select("dataset", "term", "df", lifted.alias("idf"))


def weighted_queries(queries: DataFrame, counts: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Queries as (terms, weights), weight = occurrences x idf; unknown terms are left out.

    A query of unknown terms only keeps an empty list: all its scores are 0.
    """
    item = F.struct("term", (F.col("times") * F.col("idf")).alias("weight"))
    return (
        queries.select("dataset", "query_id", F.explode_outer("tokens").alias("term"))
        .groupBy("dataset", "query_id", "term")
        .agg(F.count("*").alias("times"))
        .join(term_weights(counts, epsilon), ["dataset", "term"], "left")
        .groupBy("dataset", "query_id")
        .agg(F.sort_array(F.collect_list(F.when(F.col("idf").isNotNull(), item))).alias("items"))
        .join(one_per_dataset(corpus_size(counts)), "dataset")
        .select(
            "dataset",
            "query_id",
            F.col("items.term").alias("terms"),
            F.col("items.weight").alias("weights"),
            "avgdl",
        )
    )
