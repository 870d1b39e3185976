"""Canonical tables and the column checks made when a source is opened.

Every table starts with ``dataset`` so that a whole suite is one job.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNKED_DOCUMENTS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("chunk", T.StringType()),
        T.StructField("og_chunk", T.StringType()),
    ]
)
CHUNKED_QUERIES = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
    ]
)
CHUNKED_QUERIES_MANY = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("chunk_ids", T.ArrayType(T.StringType())),
    ]
)
TRIPLE_TEXTS = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
TRIPLE_LABELS = T.StructType(
    [
        T.StructField("query-id", T.StringType()),
        T.StructField("corpus-id", T.StringType()),
    ]
)
LENGTH_CORPUS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("context_length", T.IntegerType()),
    ]
)
LENGTH_QUERIES = T.StructType(
    [
        T.StructField("qid", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
LENGTH_LABELS = T.StructType(
    [
        T.StructField("qid", T.StringType()),
        T.StructField("doc_id", T.StringType()),
    ]
)


class SchemaError(ValueError):
    """A source lacks a column its reader needs."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaError(f"missing columns {missing}; found {df.columns}")
    return df


def id_column(df: DataFrame) -> str:
    """The label column of a chunked table: ``chunk_id`` wins over ``chunk_ids``."""
    for name in ("chunk_id", "chunk_ids"):
        if name in df.columns:
            return name
    raise SchemaError("neither chunk_id nor chunk_ids found in the source")


def one_per_dataset(rows: DataFrame) -> DataFrame:
    """Mark a table holding one short row per data set for broadcast.

    Its size is the number of data sets in the suite. A shuffled join on ``dataset`` alone
    would bring a whole corpus into one task.
    """
    return F.broadcast(rows)


@dataclass(frozen=True)
class Prompts:
    """What a flat view puts before the texts of a data set."""

    query: str = ""
    document: str = ""


@dataclass(frozen=True)
class RetrievalSet:
    """A retrieval task (or many, told apart by ``dataset``).

    corpus:  dataset, chunk_id, text [, doc_id, internal_id, og_text, context_length, chunk_pos]
    queries: dataset, query_id, text [, query_pos]
    qrels:   dataset, query_id, target_id, label_pos
    prompts: of the data sets that have any; texts are raw, views apply them
    """

    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame
    prompts: Mapping[str, Prompts] = field(default_factory=dict)

    def but(self, **tables: DataFrame) -> "RetrievalSet":
        return replace(self, **tables)

    def union(self, other: "RetrievalSet") -> "RetrievalSet":
        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.unionByName(b, allowMissingColumns=True)

        return RetrievalSet(
            both(self.corpus, other.corpus),
            both(self.queries, other.queries),
            both(self.qrels, other.qrels),
            {**self.prompts, **other.prompts},
        )
