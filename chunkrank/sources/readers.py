"""Readers that bring three source layouts to the canonical tables.

chunked:  {path}/{documents|queries}/{split}
triples:  {path}/{corpus|queries|qrels}/{split}
length:   {path}/{task}/{corpus|queries|qrels}
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkrank.functions import ids
from chunkrank.operators.views import swap_chunks
from chunkrank.schema import Prompts, RetrievalSet, id_column, require_columns
from chunkrank.sources.positions import AT, marked, numbered_in_files, numbered_within


def open_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    in_order: bool = False,
) -> DataFrame:
    """``in_order`` marks the rows with their position and keeps the scan as it is."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return marked(reader.load(path), fmt) if in_order else spread(reader.load(path))


def open_corpus(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A table of chunks: marked with its positions, then spread like any other."""
    return spread(open_table(spark, path, fmt, schema, in_order=True))


SMALL_TABLE_SPLITS = 32


def spread(scan: DataFrame) -> DataFrame:
    """Spread a table that Spark reads in very few splits over some of the cores.

    A large table has more splits than that and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = min(cores, SMALL_TABLE_SPLITS)
    return scan if scan.rdd.getNumPartitions() >= splits else scan.repartition(splits)


def with_row_position(df: DataFrame, name: str) -> DataFrame:
    """Number the rows 0, 1, … in file order, without sorting or moving them.

    Rows that were not read from files are numbered in the order of their splits: each split numbers
    its own, and only one count per split is brought together.
    """
    if name in df.columns:
        return df
    if AT in df.columns:
        return numbered_in_files(df, name)
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    split_no = F.shiftright("_row", 33)
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        numbered.groupBy(split_no.alias("_split"))
        .agg(F.count("*").alias("_rows"))
        .select("_split", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    return (
        numbered.withColumn("_split", split_no)
        # One row per split of the scan, so the broadcast side is bounded by the split count.
        .join(F.broadcast(starts), "_split")
        .withColumn(name, F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_row", "_split", "_start")
    )


def not_null(column: Column, what: str) -> Column:
    return F.when(column.isNull(), F.raise_error(F.lit(f"null {what} in the source"))).otherwise(column)


def position_of(rows: DataFrame) -> list[Column]:
    """The column that tells the last of several chunks with one id, where the source has one."""
    if "chunk_pos" in rows.columns:
        return [F.col("chunk_pos")]
    return [F.col(AT).alias("chunk_pos")] if AT in rows.columns else []


def chunked_tables(
    documents: DataFrame,
    queries: DataFrame,
    dataset: str,
    query_prompt: str = "",
    doc_prompt: str = "",
    og_ratio: float = 0.0,
    seed: int = 42,
) -> RetrievalSet:
    """Canonical tables from chunked documents and queries that name their gold chunks.

    Texts stay raw; the prompts go with the set. ``og_ratio`` of the chunks show their original text.
    """
    require_columns(documents, "chunk")
    require_columns(queries, "query")
    if id_column(documents) != "chunk_id":
        raise ValueError("a documents table is labelled by chunk_id")

    corpus = documents.select(
        F.lit(dataset).alias("dataset"),
        ids.document_of(F.col("chunk_id")).alias("doc_id"),
        ids.number_of(F.col("chunk_id")).alias("internal_id"),
        "chunk_id",
        not_null(F.col("chunk"), "chunk").alias("text"),
        *([F.col("og_chunk").alias("og_text")] if "og_chunk" in documents.columns else []),
        *position_of(documents),
    )
    if og_ratio > 0.0:
        require_columns(documents, "og_chunk")
        corpus = swap_chunks(corpus, og_ratio, seed)

    many = id_column(queries) == "chunk_ids"
    labels = F.col("chunk_ids") if many else F.array("chunk_id")
    placed = with_row_position(queries, "query_pos")
    if "query_id" not in placed.columns:
        placed = placed.withColumn("query_id", F.col("query_pos").cast("string"))
    placed = placed.select(
        F.lit(dataset).alias("dataset"),
        F.col("query_id").cast("string").alias("query_id"),
        F.col("query_pos").cast("long").alias("query_pos"),
        not_null(F.col("query"), "query").alias("text"),
        ids.document_of_list(labels).alias("doc_id"),
        ids.numbers_of_list(labels).alias("internal_ids"),
        labels.alias("chunk_ids"),
    )
    qrels = placed.select(
        "dataset", "query_id", F.posexplode("chunk_ids").alias("label_pos", "target_id")
    ).select("dataset", "query_id", "target_id", "label_pos")
    return RetrievalSet(corpus, placed, qrels, {dataset: Prompts(query_prompt, doc_prompt)})


def triple_tables(
    corpus: DataFrame,
    queries: DataFrame,
    qrels: DataFrame,
    dataset: str,
    query_prompt: str = "",
    doc_prompt: str = "",
) -> RetrievalSet:
    """Canonical tables from corpus, queries and labels. Extra columns are not read."""
    require_columns(corpus, "_id", "text")
    require_columns(queries, "_id", "text")
    require_columns(qrels, "query-id", "corpus-id")
    name = F.lit(dataset).alias("dataset")
    chunk_id = F.col("_id").cast("string")
    return RetrievalSet(
        corpus.select(
            name,
            ids.parent_id(chunk_id).alias("doc_id"),
            chunk_id.alias("chunk_id"),
            not_null(F.col("text"), "text").alias("text"),
            *position_of(corpus),
        ),
        with_row_position(queries, "query_pos").select(
            name,
            chunk_id.alias("query_id"),
            F.col("query_pos").cast("long").alias("query_pos"),
            not_null(F.col("text"), "text").alias("text"),
        ),
        with_row_position(qrels, "label_pos").select(
            name,
            F.col("query-id").cast("string").alias("query_id"),
            F.col("corpus-id").cast("string").alias("target_id"),
            F.col("label_pos").cast("long").alias("label_pos"),
        ),
        {dataset: Prompts(query_prompt, doc_prompt)},
    )


def in_length_bucket(context_length: Column, bucket: int) -> Column:
    """Documents are bucketed by number."""
    return context_length.cast("int") == F.lit(int(bucket))


def query_in_length_bucket(qid: Column, bucket: int | str | Column) -> Column:
    """Queries are bucketed by the length's digits appearing anywhere in their id."""
    needle = bucket if isinstance(bucket, Column) else F.lit(str(bucket))
    return F.contains(qid, needle)


def length_tables(
    corpus: DataFrame,
    queries: DataFrame,
    qrels: DataFrame,
    task: str,
    context_lengths: Sequence[int] | None = None,
    query_prompt: str = "",
) -> RetrievalSet:
    """Canonical tables of a length task; each requested length is a dataset of its own.

    Document texts take no prompt in this layout. Queries are numbered inside their length.
    """
    require_columns(corpus, "doc_id", "text")
    require_columns(queries, "qid", "text")
    require_columns(qrels, "qid", "doc_id")
    queries = with_row_position(queries, "query_pos")
    labels = with_row_position(qrels, "label_pos")
    names = [task]
    if context_lengths is None:
        docs = corpus.withColumn("dataset", F.lit(task))
        queries = queries.withColumn("dataset", F.lit(task))
    else:
        require_columns(corpus, "context_length")
        wanted = [int(n) for n in context_lengths]
        docs = corpus.filter(F.col("context_length").cast("int").isin(wanted)).withColumn(
            "dataset", F.concat(F.lit(f"{task}_"), F.col("context_length").cast("int").cast("string"))
        )
        names = [f"{task}_{n}" for n in wanted]
        queries = (
            queries.withColumn("_bucket", F.explode(F.array(*[F.lit(str(n)) for n in wanted])))
            .filter(query_in_length_bucket(F.col("qid"), F.col("_bucket")))
            .withColumn("dataset", F.concat(F.lit(f"{task}_"), F.col("_bucket")))
        )
        queries = numbered_within(queries.drop(AT), ["dataset"], F.col("query_pos"), "query_pos")
    return RetrievalSet(
        docs.select(
            "dataset",
            ids.parent_id(F.col("doc_id").cast("string")).alias("doc_id"),
            F.col("doc_id").cast("string").alias("chunk_id"),
            not_null(F.col("text"), "text").alias("text"),
            *position_of(docs),
        ),
        queries.select(
            "dataset",
            F.col("qid").cast("string").alias("query_id"),
            F.col("query_pos").cast("long").alias("query_pos"),
            not_null(F.col("text"), "text").alias("text"),
        ),
        labels.join(queries.select("dataset", "qid"), "qid").select(
            "dataset",
            F.col("qid").cast("string").alias("query_id"),
            F.col("doc_id").cast("string").alias("target_id"),
            F.col("label_pos").cast("long").alias("label_pos"),
        ),
        {name: Prompts(query_prompt) for name in names},
    )


def read_chunked(
    spark: SparkSession,
    path: str,
    split: str = "train",
    query_key: str = "queries",
    doc_key: str = "documents",
    query_prompt: str = "",
    doc_prompt: str = "",
    dataset: str | None = None,
    fmt: str = "parquet",
    schemas: dict[str, T.StructType] | None = None,
    og_ratio: float = 0.0,
    seed: int = 42,
) -> RetrievalSet:
    schemas = schemas or {}
    return chunked_tables(
        open_corpus(spark, f"{path}/{doc_key}/{split}", fmt, schemas.get("documents")),
        open_table(spark, f"{path}/{query_key}/{split}", fmt, schemas.get("queries"), in_order=True),
        dataset or path.rstrip("/").rsplit("/", 1)[-1],
        query_prompt,
        doc_prompt,
        og_ratio,
        seed,
    )


def read_triples(
    spark: SparkSession,
    path: str,
    split: str = "train",
    query_key: str = "queries",
    doc_key: str = "corpus",
    query_prompt: str = "",
    doc_prompt: str = "",
    dataset: str | None = None,
    fmt: str = "parquet",
    schemas: dict[str, T.StructType] | None = None,
) -> RetrievalSet:
    schemas = schemas or {}
    return triple_tables(
        open_corpus(spark, f"{path}/{doc_key}/{split}", fmt, schemas.get("corpus")),
        open_table(spark, f"{path}/{query_key}/{split}", fmt, schemas.get("queries"), in_order=True),
        open_table(spark, f"{path}/qrels/{split}", fmt, schemas.get("qrels"), in_order=True),
        dataset or path.rstrip("/").rsplit("/", 1)[-1],
        query_prompt,
        doc_prompt,
    )


def read_length_tasks(
    spark: SparkSession,
    path: str,
    task: str,
    context_lengths: Sequence[int] | None = None,
    query_key: str = "queries",
    doc_key: str = "corpus",
    query_prompt: str = "",
    fmt: str = "parquet",
    schemas: dict[str, T.StructType] | None = None,
) -> RetrievalSet:
    schemas = schemas or {}
    return length_tables(
        open_corpus(spark, f"{path}/{task}/{doc_key}", fmt, schemas.get("corpus")),
        open_table(spark, f"{path}/{task}/{query_key}", fmt, schemas.get("queries"), in_order=True),
        open_table(spark, f"{path}/{task}/qrels", fmt, schemas.get("qrels"), in_order=True),
        task,
        context_lengths,
        query_prompt,
    )
