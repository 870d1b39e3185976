"""Retrieval tasks derived from the sample tables; each uses every row and whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkrank.functions import ids
from chunkrank.operators.views import cut_by_words
from chunkrank.schema import RetrievalSet, one_per_dataset
from chunkrank.session import materialised
from chunkrank.sources.positions import AT, numbered_within
from chunkrank.sources.readers import chunked_tables, length_tables, open_table, triple_tables

LENGTH_BUCKETS = (256, 1024, 4096)
SWEEP_SIZES = (100, 250, 500, 1000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return open_table(spark, f"{sf_dir}/{name}.parquet")


def _text_id(*parts: str) -> F.Column:
    return F.concat_ws("_", *[F.col(p).cast("string") for p in parts])


# --- conversations: every turn is a chunk, every user turn asks for the turn after it --------


def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked documents layout: chunk_id, chunk."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(_text_id("conv_id", "turn").alias("chunk_id"), F.col("text").alias("chunk"))


def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked queries layout: query_id, query, chunk_id; the last turns ask for a chunk that is not there."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select("conv_id", F.col("turn").alias("own"), (F.col("turn") + 1).alias("turn"), "text").select(
        F.concat(F.lit("q"), _text_id("conv_id", "own")).alias("query_id"),
        F.col("text").alias("query"),
        _text_id("conv_id", "turn").alias("chunk_id"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> RetrievalSet:
    chunk_id = F.col("chunk_id")
    name = F.lit("conversations").alias("dataset")
    asked = conversation_questions(spark, sf_dir)
    answers = conversation_documents(spark, sf_dir).select("chunk_id")
    return RetrievalSet(
        conversation_documents(spark, sf_dir).select(
            name,
            ids.document_of(chunk_id).alias("doc_id"),
            ids.number_of(chunk_id).alias("internal_id"),
            "chunk_id",
            F.col("chunk").alias("text"),
        ),
        asked.select(
            name,
            "query_id",
            F.col("query").alias("text"),
            ids.document_of(chunk_id).alias("doc_id"),
            ids.number_of(chunk_id).alias("internal_id"),
            "chunk_id",
        ),
        asked.join(answers, "chunk_id", "left_semi").select(
            name, "query_id", F.col("chunk_id").alias("target_id"), F.lit(0).alias("label_pos")
        ),
    )


def conversation_turns_by_id(spark: SparkSession, sf_dir: str) -> RetrievalSet:
    """Chunks named by their conversation alone, so that ids repeat: the last turn in the file counts.

    Read as chunked tables; nothing but the place in the file tells which turn is the last.
    """
    turns = open_table(spark, f"{sf_dir}/conversations.parquet", in_order=True)
    chunk_id = F.concat(F.col("conv_id").cast("string"), F.lit("_0")).alias("chunk_id")
    documents = turns.select(chunk_id, F.col("text").alias("chunk"), AT)
    answers = conversation_documents(spark, sf_dir).select("chunk_id")
    answered = conversation_questions(spark, sf_dir).join(answers, "chunk_id", "left_semi")
    asked = answered.withColumn("chunk_id", F.concat(ids.parent_id(F.col("chunk_id")), F.lit("_0")))
    return chunked_tables(documents, asked, "conversations")


def conversation_source(spark: SparkSession, sf_dir: str, **options) -> RetrievalSet:
    """Conversations through the reader of chunked tables; questions are numbered in file order."""
    turns = open_table(spark, f"{sf_dir}/conversations.parquet", in_order=True)
    documents = turns.select(_text_id("conv_id", "turn").alias("chunk_id"), F.col("text").alias("chunk"), F.lower("text").alias("og_chunk"), AT)
    asked = turns.filter("role = 'user'").select(
        F.lit("conversations").alias("dataset"),
        F.col("text").alias("query"),
        F.concat_ws("_", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string")).alias("chunk_id"),
        AT,
    )
    asked = numbered_within(asked, ["dataset"], F.col(AT), "query_pos").drop(AT)
    return chunked_tables(documents, asked, "conversations", **options)


# --- document lines as chunks ----------------------------------------------------------------


def line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of every document: chunk_id, chunk, og_chunk."""
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "chunk")
    )
    return lines.filter(F.trim("chunk") != "").select(
        _text_id("doc_id", "line").alias("chunk_id"), "chunk", F.lower("chunk").alias("og_chunk")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a canonical corpus."""
    chunk_id = F.col("chunk_id")
    return line_documents(spark, sf_dir).select(
        F.lit("lines").alias("dataset"),
        ids.document_of(chunk_id).alias("doc_id"),
        ids.number_of(chunk_id).alias("internal_id"),
        "chunk_id",
        F.col("chunk").alias("text"),
        F.col("og_chunk").alias("og_text"),
    )


# --- documents that hold a benchmark passage -------------------------------------------------


#: Characters of passages that one automaton holds; more make several passes over the documents.
AUTOMATON_CHARACTERS = 8_000_000


def _found_passages(documents: DataFrame, passages: list[tuple[int, str]]) -> DataFrame:
    """(item_id, doc_id, start_word) of the passages in every text, by one automaton for all of them."""
    import ahocorasick

    by_text: dict[str, list[int]] = {}
    for item_id, text in passages:
        by_text.setdefault(text, []).append(item_id)
    automaton = ahocorasick.Automaton()
    for number, text in enumerate(by_text):
        if text:
            automaton.add_word(text, (number, len(text)))
    automaton.make_automaton()
    items = list(by_text.values())
    always = by_text.get("", [])
    shared = documents.sparkSession.sparkContext.broadcast((automaton if len(automaton) else None, items, always))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, of, everywhere = shared.value
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                if text is None:
                    continue
                first: dict[int, int] = {}
                for end, (number, length) in found.iter(text) if found is not None else ():
                    first.setdefault(number, end + 1 - length)
                rows += [(item, doc_id, 0) for item in everywhere]
                for number, start in first.items():
                    before = len(re.findall(r"[^ \t\n\x0b\f\r]+", text[:start]))
                    rows += [(item, doc_id, before) for item in of[number]]
            columns = list(zip(*rows)) if rows else [[], [], []]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "doc_id", "start_word"])

    return documents.mapInArrow(search, "item_id long, doc_id long, start_word int")


def passage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id, start_word): documents whose text contains the passage.

    One pass over the texts, where they are read: no word and no text is shuffled, and passages of any
    length count. The passages come to the driver in parts of bounded size, one automaton each.
    """
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    passages = table(spark, sf_dir, "benchmark").filter("text is not null").select(F.col("item_id").cast("long"), "text")
    parts, held, size = [], [], 0
    for item_id, text in passages.toLocalIterator():
        held.append((item_id, text))
        size += len(text)
        if size >= AUTOMATON_CHARACTERS:
            parts.append(_found_passages(documents, held))
            held, size = [], 0
    if held or not parts:
        parts.append(_found_passages(documents, held))
    return reduce(DataFrame.unionByName, parts)


def passages(spark: SparkSession, sf_dir: str, query_prefix: str = "q", labelled: bool = True) -> RetrievalSet:
    """Whole documents as chunks; benchmark passages as queries with any number of labels.

    The labels are small and read by several jobs, so they are written once, unless they are not needed.
    """
    labels = passage_labels(spark, sf_dir)
    labels = materialised(labels) if labelled else labels
    name = F.lit("passages").alias("dataset")
    query_id = F.concat(F.lit(query_prefix), F.col("item_id").cast("string")).alias("query_id")
    doc_id = F.col("doc_id").cast("string")
    return RetrievalSet(
        table(spark, sf_dir, "documents").select(
            name, doc_id.alias("doc_id"), doc_id.alias("chunk_id"), "text"
        ),
        table(spark, sf_dir, "benchmark").select(
            name, query_id, F.col("item_id").alias("query_pos"), "text"
        ),
        labels.select(name, query_id, doc_id.alias("target_id"), F.col("doc_id").alias("label_pos")),
    )


def passage_triples(spark: SparkSession, sf_dir: str, **options) -> RetrievalSet:
    """The same through the reader of triples; labels are numbered by passage and document."""
    corpus = open_table(spark, f"{sf_dir}/documents.parquet", in_order=True)
    queries = open_table(spark, f"{sf_dir}/benchmark.parquet", in_order=True)
    name = F.lit("triples").alias("dataset")
    labels = passage_labels(spark, sf_dir).select(name, "item_id", "doc_id")
    labels = numbered_within(labels, ["dataset"], F.struct("item_id", "doc_id"), "label_pos")
    return triple_tables(
        corpus.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"), AT),
        queries.select(F.col("item_id").alias("_id"), "text", AT),
        labels.select(F.col("item_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), "label_pos"),
        "triples",
        **options,
    )


def answerable(data: RetrievalSet) -> RetrievalSet:
    """Without the queries nobody labelled."""
    labelled = data.queries.join(data.qrels, ["dataset", "query_id"], "left_semi")
    return data.but(queries=labelled)


# --- vectors: five consecutive ones form a document, each asks for its neighbours ------------


def vectors(spark: SparkSession, sf_dir: str) -> RetrievalSet:
    parent = F.floor(F.col("vec_id") / 5)
    chunk_id = F.concat_ws("_", parent.cast("string"), (F.col("vec_id") % 5).cast("string"))
    corpus = table(spark, sf_dir, "embeddings").select(
        F.lit("vectors").alias("dataset"),
        parent.cast("string").alias("doc_id"),
        (F.col("vec_id") % 5).cast("int").alias("internal_id"),
        chunk_id.alias("chunk_id"),
        F.col("embedding").alias("vector"),
    )
    queries = corpus.select("dataset", F.col("chunk_id").alias("query_id"), "vector")
    around = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("other")
    wanted = (
        corpus.select("dataset", "doc_id", "internal_id", F.col("chunk_id").alias("query_id"), around)
        .filter("other <> internal_id")
        .select(
            "dataset",
            "query_id",
            F.concat_ws("_", "doc_id", F.col("other").cast("string")).alias("chunk_id"),
            F.col("other").alias("label_pos"),
        )
    )
    qrels = wanted.join(corpus, ["dataset", "chunk_id"], "left_semi").select(
        "dataset", "query_id", F.col("chunk_id").alias("target_id"), "label_pos"
    )
    return RetrievalSet(corpus, queries, qrels)


# --- token vectors: queries of four, chunks of three and seven -------------------------------


def query_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.lit("tokens").alias("dataset"),
        F.concat(F.lit("q"), F.floor(F.col("vec_id") / 4).cast("string")).alias("query_id"),
        (F.col("vec_id") % 4).cast("int").alias("tok_pos"),
        F.col("embedding").alias("vector"),
    )


def chunk_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = (F.col("vec_id") % 10 >= 3).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        F.lit("tokens").alias("dataset"),
        F.concat_ws("_", F.floor(F.col("vec_id") / 10).cast("string"), late.cast("string")).alias("chunk_id"),
        (F.col("vec_id") % 10 - late * 3).cast("int").alias("tok_pos"),
        F.col("embedding").alias("vector"),
    )


def token_vectors(spark: SparkSession, sf_dir: str) -> RetrievalSet:
    """Gold chunk of a query: the one holding its first token."""
    from chunkrank.operators.encode import token_matrices

    first = F.col("vec_id") % 4 == 0
    late = (F.col("vec_id") % 10 >= 3).cast("int")
    qrels = (
        table(spark, sf_dir, "embeddings")
        .filter(first)
        .select(
            F.lit("tokens").alias("dataset"),
            F.concat(F.lit("q"), F.floor(F.col("vec_id") / 4).cast("string")).alias("query_id"),
            F.concat_ws("_", F.floor(F.col("vec_id") / 10).cast("string"), late.cast("string")).alias("target_id"),
            F.lit(0).alias("label_pos"),
        )
    )
    return RetrievalSet(
        token_matrices(chunk_token_rows(spark, sf_dir), "chunk_id"),
        token_matrices(query_token_rows(spark, sf_dir), "query_id"),
        qrels,
    )


def whole_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors of whole documents of twenty, which know their offset and no chunk."""
    return table(spark, sf_dir, "embeddings").select(
        F.lit("late").alias("dataset"),
        F.floor(F.col("vec_id") / 20).cast("string").alias("doc_id"),
        (F.col("vec_id") % 20).cast("int").alias("offset"),
        F.col("embedding").alias("vector"),
    )


def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of seven tokens, a new one every five, of the documents above."""
    documents = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).cast("string").alias("doc_id")).distinct()
    begin = F.explode(F.array(*[F.lit(b) for b in (0, 5, 10, 15)])).alias("begin")
    return documents.select(F.lit("late").alias("dataset"), "doc_id", begin).select(
        "dataset",
        "doc_id",
        F.concat_ws("_", "doc_id", (F.col("begin") / 5).cast("int").cast("string")).alias("chunk_id"),
        "begin",
        (F.col("begin") + 7).alias("end"),
    )


# --- a supplied run with holes -----------------------------------------------------------------


def run_with_holes(spark: SparkSession, sf_dir: str) -> RetrievalSet:
    """Every source scores every document but some; some it scores twice instead of the next.

    ``queries`` holds the run.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    name = F.lit("runs").alias("dataset")
    corpus = documents.select(name, F.col("doc_id").cast("string").alias("chunk_id"))
    sources = documents.select("source").distinct()
    # As many sources as the table names; each task takes them to its documents.
    every = sources.groupBy(name).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    pairs = documents.select(name, "doc_id").join(one_per_dataset(every), "dataset").select("doc_id", F.explode("sources").alias("query_id"))
    number = F.regexp_extract("query_id", r"(\d+)", 1).cast("int")
    hole = (F.col("doc_id") % 97 == number) & (number % 3 == 0)
    twice = (F.col("doc_id") % 89 == number) & (number % 3 == 1)
    target = F.when(twice, F.col("doc_id") - 1).otherwise(F.col("doc_id")).cast("string")
    run = pairs.filter(~hole).select(name, "query_id", target.alias("target_id"), F.lit(0.5).alias("score"))
    qrels = documents.select(name, F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("target_id"))
    return RetrievalSet(corpus, run, qrels)


# --- length buckets --------------------------------------------------------------------------


def length_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The length layout: corpus, queries and labels; one query per bucket holding a label."""
    chars = F.col("n_chars")
    bucket = F.when(chars < 1024, 256).when(chars < 4096, 1024).otherwise(4096)
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", bucket.alias("context_length")
    )
    labels = materialised(passage_labels(spark, sf_dir)).select("item_id", F.col("doc_id").cast("string").alias("doc_id"))
    placed = labels.join(documents.select("doc_id", "context_length"), "doc_id").select(
        "item_id",
        "doc_id",
        "context_length",
        F.concat(F.lit("q"), _text_id("item_id", "context_length")).alias("qid"),
    )
    # Queries stand in the order of their passages, then of their lengths.
    query_pos = F.col("item_id") * 100_000 + F.col("context_length")
    queries = (
        placed.select("item_id", "qid", "context_length")
        .distinct()
        .join(table(spark, sf_dir, "benchmark"), "item_id")
        .select("qid", "text", query_pos.alias("query_pos"))
    )
    qrels = placed.select("qid", "doc_id", F.col("doc_id").cast("long").alias("label_pos"))
    return documents, queries, qrels


def length_task(spark: SparkSession, sf_dir: str, task: str = "needle") -> RetrievalSet:
    return length_tables(*length_sources(spark, sf_dir), task, LENGTH_BUCKETS)


# --- chunk-size sweep ------------------------------------------------------------------------


def sweep(spark: SparkSession, sf_dir: str) -> RetrievalSet:
    """Documents cut at every size; a passage's gold chunk is the one it starts in."""
    corpus = cut_by_words(table(spark, sf_dir, "documents"), SWEEP_SIZES)
    size = F.explode(F.array(*[F.lit(n) for n in SWEEP_SIZES])).alias("size")
    name = F.concat(F.lit("words-"), F.col("size").cast("string")).alias("dataset")
    query_id = F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id")
    qrels = materialised(passage_labels(spark, sf_dir)).select("*", size).select(
        name,
        query_id,
        F.concat_ws(
            "_", F.col("doc_id").cast("string"), F.floor(F.col("start_word") / F.col("size")).cast("string")
        ).alias("target_id"),
        F.col("doc_id").alias("label_pos"),
    )
    queries = table(spark, sf_dir, "benchmark").select("item_id", "text", size).select(name, query_id, "text")
    return answerable(RetrievalSet(corpus, queries, qrels))


# --- plug-ins whose vectors can be checked by counting --------------------------------------


def text_sizes():
    """A plug-in: characters and words of every text."""
    return lambda texts: [[len(t), t.count(" ") + 1] for t in texts]


def limited_sizes(max_tokens=None, extended_context=False):
    """A plug-in that keeps the limits it is told, and says which: characters read, limit."""
    limit = None if extended_context else max_tokens

    def model(texts):
        return [[len(t if limit is None else " ".join(t.split(" ")[:limit])), limit or 0] for t in texts]

    return model


def document_sizes():
    """A contextual plug-in: the chunk's place, and the words of its whole document."""
    def model(documents):
        out = []
        for texts in documents:
            total = sum(len([t for t in re.split(r"[\W_]+", text.lower()) if t]) for text in texts)
            out.append([[place + 1, total] for place in range(len(texts))])
        return out

    return model
