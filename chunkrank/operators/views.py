"""Nested, flat and prompted views of a corpus; the chunk swap; the chunker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkrank.functions import ids
from chunkrank.functions.text import draw, prompted, prompted_by_dataset
from chunkrank.schema import RetrievalSet


def nested(
    rows: DataFrame,
    col: str = "text",
    id_col: str = "chunk_id",
    order_by: str = "internal_id",
) -> DataFrame:
    """One row per document with its values and ids as parallel lists.

    A list is as long as its document. Plans keep the long form (document, place, chunk); lists are
    a form of output.
    """
    item = F.struct(
        F.col(order_by).alias("place"), F.col(id_col).alias("id"), F.col(col).alias("value")
    )
    return (
        rows.groupBy("dataset", "doc_id")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select(
            "dataset",
            "doc_id",
            F.col("items.value").alias(f"{col}s"),
            F.col("items.id").alias(f"{id_col}s"),
        )
    )


def flatten(nested_rows: DataFrame, values: str, id_lists: str, value: str, id_name: str) -> DataFrame:
    """Back to one row per element of the parallel lists."""
    pairs = F.arrays_zip(F.col(id_lists).alias("id"), F.col(values).alias("value"))
    return nested_rows.select("dataset", "doc_id", F.posexplode(pairs).alias("place", "pair")).select(
        "dataset",
        "doc_id",
        "place",
        F.col("pair.id").alias(id_name),
        F.col("pair.value").alias(value),
    )


def singletons(corpus: DataFrame, col: str = "text") -> DataFrame:
    """Each chunk as a document of one chunk, for sources without documents."""
    return corpus.select(
        "dataset",
        F.col("chunk_id").alias("doc_id"),
        F.array(col).alias(f"{col}s"),
        F.array("chunk_id").alias("chunk_ids"),
    )


def flat_documents(corpus: DataFrame, prompt: str = "", col: str = "text") -> DataFrame:
    return corpus.select("dataset", "chunk_id", prompted(F.col(col), prompt).alias(col))


def flat_queries(queries: DataFrame, prompt: str = "") -> DataFrame:
    return queries.select("dataset", "query_id", prompted(F.col("text"), prompt).alias("text"))


def with_prompts(data: RetrievalSet, by_document: bool = False, nested_queries: bool = False) -> RetrievalSet:
    """The set with the prompts of its flat views put before the texts.

    Chunks that are seen by document take none, chunks of a source without documents do; queries
    that are seen by document take none either.
    """
    query = {name: p.query for name, p in data.prompts.items()}
    document = {name: p.document for name, p in data.prompts.items()}
    corpus, queries = data.corpus, data.queries
    if any(document.values()) and "text" in corpus.columns:
        text = prompted_by_dataset(F.col("text"), F.col("dataset"), document)
        if by_document and {"doc_id", "internal_id"} <= set(corpus.columns):
            text = F.when(F.col("internal_id").isNull(), text).otherwise(F.col("text"))
        corpus = corpus.withColumn("text", text)
    if any(query.values()) and "text" in queries.columns and not nested_queries:
        queries = queries.withColumn("text", prompted_by_dataset(F.col("text"), F.col("dataset"), query))
    return data.but(corpus=corpus, queries=queries, prompts={})


def collected_labels(qrels: DataFrame) -> DataFrame:
    """Labels of each query as one list in input order, duplicates kept."""
    item = F.struct("label_pos", "target_id")
    return (
        qrels.groupBy("dataset", "query_id")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select("dataset", "query_id", F.col("items.target_id").alias("target_ids"))
    )


def swap_chunks(corpus: DataFrame, ratio: float = 0.0, seed: int = 42) -> DataFrame:
    """Use the original text for about ``ratio`` of the chunks, the same ones on every run.

    Texts are raw here: prompts are put before whichever text a view shows.
    """
    if ratio <= 0.0:
        return corpus
    chosen = draw(seed, F.col("chunk_id")) < F.lit(float(ratio))
    return corpus.withColumn("text", F.when(chosen, F.col("og_text")).otherwise(F.col("text")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def cut_by_words(documents: DataFrame, sizes: Sequence[int], name: str = "words") -> DataFrame:
    """Chunks of ``size`` words at every requested size; ``dataset`` tells the sizes apart.

    All chunks of a text are cut in one expression, so the word list is never copied per chunk.
    """
    every = F.col("words")

    def cut(size: Column) -> Column:
        last = F.ceil(F.size(every) / size).cast("int") - 1
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                size.alias("chunk_size"),
                i.alias("internal_id"),
                F.array_join(F.slice(every, i * size + 1, size), " ").alias("text"),
            ),
        )

    wanted = F.array(*[F.lit(int(n)) for n in sizes])
    doc_id = F.col("doc_id").cast("string")
    return (
        documents.select(doc_id.alias("doc_id"), words(F.col("text")).alias("words"))
        .filter(F.size("words") > 0)
        .select("doc_id", F.inline(F.flatten(F.transform(wanted, cut))))
        .select(
            F.concat(F.lit(f"{name}-"), F.col("chunk_size").cast("string")).alias("dataset"),
            "doc_id",
            "internal_id",
            F.concat_ws("_", "doc_id", F.col("internal_id").cast("string")).alias("chunk_id"),
            "text",
        )
    )


def parents(rows: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return rows.select("dataset", ids.parent_id(F.col(id_col)).alias("parent")).distinct()


def label_positions(qrels: DataFrame) -> DataFrame:
    """Position of each query's first label."""
    first = F.min(F.struct("label_pos", "target_id"))["target_id"]
    return qrels.groupBy("dataset", "query_id").agg(ids.position(first).alias("position"))
