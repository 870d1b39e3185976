"""Size statistics of a corpus and its queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkrank.operators.bm25 import tokenised
from chunkrank.operators.views import with_prompts
from chunkrank.schema import RetrievalSet, one_per_dataset


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """Documents, and mean tokens per document, per chunk (mean of document means), and chunks."""
    documents = (
        tokenised(corpus)
        .groupBy("dataset", "doc_id")
        .agg(
            F.sum(F.size("tokens")).alias("tokens"),
            F.avg(F.size("tokens")).alias("per_chunk"),
            F.count("*").alias("chunks"),
        )
    )
    return documents.groupBy("dataset").agg(
        F.count("*").alias("num_docs"),
        F.avg("tokens").alias("average_num_tokens_per_doc"),
        F.avg("per_chunk").alias("average_num_tokens_per_chunk"),
        F.avg("chunks").alias("average_num_chunks_per_doc"),
    )


def query_stats(queries: DataFrame) -> DataFrame:
    return (
        tokenised(queries)
        .groupBy("dataset")
        .agg(
            F.count("*").alias("num_queries"),
            F.avg(F.size("tokens")).alias("average_num_tokens_per_query"),
        )
    )


def dataset_stats(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    return query_stats(queries).join(one_per_dataset(corpus_stats(corpus)), "dataset")


def set_stats(data: RetrievalSet) -> DataFrame:
    """Statistics of a set: documents as they are, queries with their prompt."""
    return dataset_stats(data.corpus, with_prompts(data).queries)
