
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles  # noqa: E402
from chunkrank import workloads as w  # noqa: E402
from chunkrank.functions import ids  # noqa: E402
from chunkrank.functions.text import DOCUMENT_PROMPT, QUERY_PROMPT  # noqa: E402
from chunkrank.functions.vectors import l2_normalised  # noqa: E402
from chunkrank.operators import analysis, bm25, checks, encode, metrics, stats, views  # noqa: E402
from chunkrank.plans.evaluate import (  # noqa: E402
    dense,
    evaluate,
    lexical,
    maxsim,
    ranked,
    summarise,
    with_positional_ids,
)
from chunkrank.plans.suites import length_suite_metrics  # noqa: E402
from chunkrank.session import shared_dir  # noqa: E402
from chunkrank.sources import registry, sinks  # noqa: E402
from chunkrank.sources.readers import (  # noqa: E402
    in_length_bucket,
    query_in_length_bucket,
)

Query = Callable[[SparkSession, str], DataFrame]
SMOKE = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Dense retrieval end to end: score, rank, nDCG@10."""
    return dense_ndcg_at_10(spark, SMOKE)


def _run_rows(run: DataFrame) -> DataFrame:
    return run.select("dataset", "query_id", "target_id", "score", F.col("rank").cast("long").alias("rank"))


def _joined(column: str, separator: str = " ") -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), separator).alias(column)


def _elements(vectors: DataFrame, *names: str) -> DataFrame:
    long = vectors.select(*names, F.posexplode("vector").alias("dim", "value"))
    return long.select(*names, "dim", F.round("value", 6).alias("value"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- ids and views ---------------------------------------------------------------------------


def parse_chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.conversations(spark, sf_dir).corpus.select("chunk_id", "doc_id", "internal_id")


def parse_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = views.nested(w.lines(spark, sf_dir))
    lists = F.col("chunk_ids")
    return nested.select(
        ids.document_of_list(lists).alias("doc_id"),
        F.array_join(lists, " ").alias("chunk_ids"),
        F.array_join(ids.numbers_of_list(lists).cast("array<string>"), " ").alias("internal_ids"),
    )


def parent_and_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk_id = F.col("chunk_id")
    return w.conversation_documents(spark, sf_dir).select(
        chunk_id, ids.parent_id(chunk_id).alias("parent"), ids.position(chunk_id).alias("position")
    )


def distinct_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = w.conversations(spark, sf_dir)
    positions = views.label_positions(data.qrels).select("position").distinct()
    return (
        views.parents(data.corpus)
        .select(F.lit("parent").alias("kind"), F.col("parent").alias("value"))
        .unionByName(positions.select(F.lit("position").alias("kind"), F.col("position").alias("value")))
    )


def chunk_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.swap_chunks(w.lines(spark, sf_dir), 0.3).select("chunk_id", "text")


def prompted_flat_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.flat_documents(w.lines(spark, sf_dir), DOCUMENT_PROMPT).select("chunk_id", "text")


def prompted_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.flat_queries(w.conversations(spark, sf_dir).queries, QUERY_PROMPT).select(
        "query_id", "text"
    )


def nested_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = views.nested(w.conversations(spark, sf_dir).corpus)
    return nested.select("doc_id", _joined("chunk_ids"), _joined("texts", " | "))


def nested_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = views.nested(w.conversations(spark, sf_dir).queries)
    return nested.select("doc_id", _joined("chunk_ids"), _joined("texts", " | "))


def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = views.nested(w.conversations(spark, sf_dir).corpus)
    flat = views.flatten(nested, "texts", "chunk_ids", "text", "chunk_id")
    return flat.select("doc_id", "chunk_id", "text", F.col("place").cast("long").alias("place"))


def singleton_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = views.singletons(w.passages(spark, sf_dir, labelled=False).corpus)
    return lists.select("doc_id", _joined("chunk_ids"), _joined("texts", " | "))


def collect_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = views.collected_labels(w.passages(spark, sf_dir).qrels)
    return lists.select("query_id", _joined("target_ids"))


def context_filter_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _, _ = w.length_sources(spark, sf_dir)
    return documents.filter(in_length_bucket(F.col("context_length"), 256)).select("doc_id", "text")


def context_filter_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, queries, _ = w.length_sources(spark, sf_dir)
    return queries.filter(query_in_length_bucket(F.col("qid"), 256)).select("qid", "text")


def chunked_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and their labels as the reader of chunked tables numbers them."""
    data = w.conversation_source(spark, sf_dir)
    named = data.queries.select("query_id", "query_pos", "text", "doc_id")
    return named.join(data.qrels.select("query_id", "target_id", "label_pos"), "query_id")


def triple_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries and labels as the reader of triples gives them."""
    data = w.passage_triples(spark, sf_dir)
    return data.queries.join(data.qrels, ["dataset", "query_id"]).select("query_id", "query_pos", "target_id", "label_pos")


def length_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries numbered inside each length."""
    return w.length_task(spark, sf_dir).queries.select("dataset", "query_id", "query_pos")


def swap_then_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some chunks show their original text; the prompt is before either."""
    data = w.conversation_source(spark, sf_dir, doc_prompt=DOCUMENT_PROMPT, og_ratio=0.3)
    return views.with_prompts(data).corpus.select("chunk_id", "text")


def nested_without_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view by document shows the texts alone, whatever the prompt of the flat one."""
    data = w.conversation_source(spark, sf_dir, query_prompt=QUERY_PROMPT, doc_prompt=DOCUMENT_PROMPT)
    nested = views.nested(views.with_prompts(data, by_document=True).corpus)
    return nested.select("doc_id", _joined("chunk_ids"), _joined("texts", " | "))


def prompted_set_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics count the prompt of the queries and none of the documents."""
    data = w.conversation_source(spark, sf_dir, query_prompt=QUERY_PROMPT, doc_prompt=DOCUMENT_PROMPT)
    found = stats.set_stats(data)
    return _rounded(found, "average_num_tokens_per_query", *CORPUS_AVERAGES).drop("dataset")


# --- joins and checks ------------------------------------------------------------------------


def query_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = w.passages(spark, sf_dir)
    return checks.labelled_queries(data.queries, data.qrels).select("query_id", "text", "target_id")


def label_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled by their source, judged against the corpus of rated documents."""
    name = F.lit("rated").alias("dataset")
    doc_id = F.col("doc_id").cast("string")
    qrels = w.table(spark, sf_dir, "documents").select(
        name, F.col("source").alias("query_id"), doc_id.alias("target_id")
    )
    corpus = w.table(spark, sf_dir, "labels").select(name, doc_id.alias("chunk_id"))
    return checks.label_violations(qrels, corpus).select("query_id", "target_id")


def unlabelled_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = w.passages(spark, sf_dir)
    return checks.unlabelled_queries(data.queries, data.qrels).select("query_id")


def evaluated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = w.passages(spark, sf_dir)
    return checks.evaluated_queries(ranked(lexical(data)), data.qrels).select("query_id")


def run_shape_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = w.vectors(spark, sf_dir)
    shape = checks.run_shape(ranked(dense(data)), data.corpus, data.qrels)
    return shape.select("query_id", "scored", "chunks", "complete")


def run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplied run with holes and repeats: which queries score every chunk once."""
    data = w.run_with_holes(spark, sf_dir)
    found = checks.run_coverage(data.queries, data.corpus, data.qrels)
    return found.select("query_id", "scored", "chunks", "complete")


def coverage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that are missing, repeated or unknown in that run."""
    data = w.run_with_holes(spark, sf_dir)
    found = checks.coverage_faults(data.queries, data.corpus, data.qrels)
    return found.select("query_id", "target_id", "fault", "times")


def _turns_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.table(spark, sf_dir, "conversations").select(
        F.lit("turns").alias("dataset"), F.col("conv_id").cast("string").alias("chunk_id"), "turn", "text"
    )


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_ids(_turns_as_chunks(spark, sf_dir)).select("chunk_id", "copies")


def duplicate_ids_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids that repeat: the last chunk of an id, by its place in the file, is the one that is scored."""
    return evaluate(w.conversation_turns_by_id(spark, sf_dir), "bm25")


def keep_last_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.keep_last(_turns_as_chunks(spark, sf_dir), "turn").select("chunk_id", "text")


def registry_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = registry.registry_frame(
        spark, {"src0": {}, "src1": {"path": "first"}, "src2": {"split": "test"}, "src3": {}}
    )
    requested = w.table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"))
    return registry.resolve(requested, known).select("dataset", "status", "path", "split")


# --- vectors and dense retrieval -------------------------------------------------------------


def vector_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.vector_lengths(w.vectors(spark, sf_dir).corpus).select("dim", "vectors")


def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = w.table(spark, sf_dir, "embeddings")
    return _elements(rows.select("vec_id", l2_normalised(F.col("embedding")).alias("vector")), "vec_id")


def mean_over_docs_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = encode.mean_over_documents(w.vectors(spark, sf_dir).corpus)
    return _elements(means.withColumnRenamed("chunk_id", "parent"), "parent")


def dense_scores_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_rows(ranked(dense(w.vectors(spark, sf_dir))))


def dense_tiles_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run by the form for any number of queries, with floors from a first pass."""
    return _run_rows(ranked(dense(w.vectors(spark, sf_dir)), form="tiles", with_floors=True))


def dense_ndcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = w.vectors(spark, sf_dir)
    run = ranked(dense(data), k=10)
    return metrics.macro_metrics(metrics.per_query_metrics(run, data.qrels, ks=(10,)), names=["ndcg_at_10"])


def dense_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(w.vectors(spark, sf_dir), "dense", check=False)


def dense_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = w.vectors(spark, sf_dir)
    each = metrics.per_query_metrics(ranked(dense(data)), data.qrels)
    return _rounded(each, *metrics.metric_names()).drop("dataset")


def mean_over_docs_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(w.vectors(spark, sf_dir), "dense", mean_over_docs=True, check=False)


def identical_id_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries named by bare numbers, as the documents are: the namesake is left out."""
    return _run_rows(ranked(lexical(w.passages(spark, sf_dir, query_prefix="", labelled=False))))


def identical_id_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries renamed to their row number, which shadows documents the same way."""
    return _run_rows(ranked(lexical(with_positional_ids(w.passages(spark, sf_dir, labelled=False)))))


# --- late interaction ------------------------------------------------------------------------


def maxsim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_rows(ranked(maxsim(w.token_vectors(spark, sf_dir))))


def maxsim_pad_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_rows(ranked(maxsim(w.token_vectors(spark, sf_dir), pad_floor=True)))


def maxsim_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(w.token_vectors(spark, sf_dir), "maxsim", check=False)


# --- lexical ---------------------------------------------------------------------------------


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = bm25.tokenised(w.passages(spark, sf_dir, labelled=False).corpus)
    weights = bm25.term_weights(bm25.term_counts(corpus))
    return _rounded(weights.select("term", "df", "idf"), "idf")


def bm25_scores_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_rows(ranked(lexical(w.conversations(spark, sf_dir))))


def bm25_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(w.answerable(w.passages(spark, sf_dir)), "bm25", check=False)


def bm25_tiles_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_rows(ranked(lexical(w.conversations(spark, sf_dir)), form="tiles", with_floors=True))


def contextual_triples_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contextual model on a source without documents: every chunk is a document of its own."""
    data = w.answerable(w.passage_triples(spark, sf_dir))
    return evaluate(data, "contextual", factory=w.text_sizes, contextual_factory=w.document_sizes)


# --- analyses --------------------------------------------------------------------------------


def parent_max_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = w.conversations(spark, sf_dir)
    run = ranked(lexical(data), k=0, parents=True)
    return summarise(run, data.qrels, ks=(10,))


def positional_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = w.conversations(spark, sf_dir)
    each = metrics.per_query_metrics(ranked(lexical(data), k=10), data.qrels, ks=(10,))
    return analysis.positional_metrics(each, data.qrels)


def scaling_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = w.conversations(spark, sf_dir).corpus
    return analysis.scaling_samples(corpus).select("n", F.col("trial").cast("long").alias("trial"), "parent")


def scaling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lexical(w.conversations(spark, sf_dir))
    means = analysis.scale_scored(scored.queries, scored.chunks, scored.qrels, scored.scorer)
    return _rounded(means, "value")


def scaling_by_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the plan that is bounded by the draw, for corpora where scoring all pairs costs more."""
    scored = lexical(w.conversations(spark, sf_dir))
    means = analysis.scale_scored(scored.queries, scored.chunks, scored.qrels, scored.scorer, form="trial")
    return _rounded(means, "value")


CORPUS_AVERAGES = (
    "average_num_tokens_per_doc",
    "average_num_tokens_per_chunk",
    "average_num_chunks_per_doc",
)


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.corpus_stats(w.lines(spark, sf_dir)), *CORPUS_AVERAGES).drop("dataset")


def query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.query_stats(w.conversations(spark, sf_dir).queries)
    return _rounded(found, "average_num_tokens_per_query").drop("dataset")


def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = w.conversations(spark, sf_dir)
    found = stats.dataset_stats(data.corpus, data.queries)
    return _rounded(found, "average_num_tokens_per_query", *CORPUS_AVERAGES).drop("dataset")


# --- suites ----------------------------------------------------------------------------------


def multi_context_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = length_suite_metrics(w.length_task(spark, sf_dir), method="bm25", check=False)
    return _rounded(found, "value")


def suite_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two data sets of different layouts, evaluated by one job."""
    both = registry.merge([w.conversations(spark, sf_dir), w.answerable(w.passages(spark, sf_dir))])
    return evaluate(both, "bm25", check=False)


def chunk_size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(w.sweep(spark, sf_dir), "bm25", check=False)


# --- encoders --------------------------------------------------------------------------------


def hash_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(encode.hash_encode(w.conversations(spark, sf_dir).corpus), "chunk_id")


def contextual_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = encode.hash_encode(w.conversations(spark, sf_dir).corpus)
    return _elements(encode.blend_with_document(chunks), "chunk_id")


def pool_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(encode.pool_tokens(w.chunk_token_rows(spark, sf_dir)), "chunk_id")


def late_chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late chunking of untagged token rows by overlapping spans."""
    found = encode.late_chunks(w.whole_document_tokens(spark, sf_dir), w.overlapping_spans(spark, sf_dir), width=4)
    return _elements(found, "chunk_id")


def plugin_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plug-in that keeps its limit itself, one that is given cut texts, one with its limit lifted."""
    corpus = w.conversations(spark, sf_dir).corpus.select("dataset", "chunk_id", "text")
    told = encode.encode(corpus, w.limited_sizes, max_tokens=5)
    cut = encode.encode(corpus, w.text_sizes, max_tokens=5)
    lifted = encode.encode(corpus, w.limited_sizes, max_tokens=5, extended_context=True)
    each = [
        df.select("chunk_id", F.col("vector")[0].cast("long").alias(name))
        for df, name in ((told, "told"), (cut, "cut"), (lifted, "lifted"))
    ]
    return each[0].join(each[1], "chunk_id").join(each[2], "chunk_id")


def plugin_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode.encode(w.conversations(spark, sf_dir).corpus, w.text_sizes, prompt=DOCUMENT_PROMPT)
    size = F.col("vector").cast("array<long>")
    return rows.select("chunk_id", size[0].alias("chars"), size[1].alias("words"))


def plugin_contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode.encode_in_context(w.conversations(spark, sf_dir).corpus, w.document_sizes)
    size = F.col("vector").cast("array<long>")
    return rows.select("chunk_id", size[0].alias("place"), size[1].alias("document_tokens"))


# --- sinks -----------------------------------------------------------------------------------


def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run description beside the metrics it belongs to."""
    about = sinks.run_metadata(spark, "builtin/dot", "dot", "dense", runtime=0.0, date="2000-01-01 00:00:00")
    found = dense_ndcg_at_10(spark, sf_dir).withColumn("model_name", F.lit("dot"))
    return found.join(F.broadcast(about), "model_name")


def metrics_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = sinks.write_metrics(
        dense_metrics(spark, sf_dir),
        sinks.run_metadata(spark, "builtin/dot", "dot", "dense"),
        shared_dir(spark),
        "dot",
        "dense",
    )
    return sinks.read_metrics(spark, target).select("dataset", "metric", "value")


REGISTERED: tuple[Query, ...] = (
    parse_chunk_id,
    parse_chunk_ids,
    parent_and_position,
    distinct_parents,
    chunk_swap,
    prompted_flat_docs,
    prompted_queries,
    nested_docs,
    nested_queries,
    flatten_nested,
    singleton_nested,
    collect_labels,
    context_filter_docs,
    context_filter_queries,
    chunked_source,
    triple_source,
    length_positions,
    swap_then_prompt,
    nested_without_prompt,
    prompted_set_stats,
    query_label_join,
    label_violations,
    unlabelled_queries,
    evaluated_queries,
    run_shape_check,
    run_coverage,
    coverage_faults,
    duplicate_ids,
    duplicate_ids_metrics,
    keep_last_duplicate,
    registry_skip,
    vector_dims,
    l2_normalise,
    mean_over_docs_vectors,
    dense_scores_topk,
    dense_tiles_topk,
    dense_ndcg_at_10,
    dense_metrics,
    dense_per_query,
    mean_over_docs_metrics,
    identical_id_filter,
    identical_id_compat,
    maxsim_scores,
    maxsim_pad_floor,
    maxsim_metrics,
    bm25_idf,
    bm25_scores_topk,
    bm25_tiles_topk,
    bm25_metrics,
    contextual_triples_metrics,
    parent_max_metrics,
    positional_metrics,
    scaling_samples,
    scaling_metrics,
    scaling_by_trial,
    corpus_stats,
    query_stats,
    dataset_stats,
    multi_context_avg,
    suite_metrics,
    chunk_size_sweep,
    hash_encode,
    contextual_encode,
    pool_tokens,
    late_chunk_vectors,
    plugin_limits,
    plugin_encode,
    plugin_contextual,
    run_metadata,
    metrics_sink_roundtrip,
)


# --- training-data operators -----------------------------------------------------------------

try:
    from chunkrank.llm import queries as llm  # noqa: E402
except ModuleNotFoundError as e:
    # The subpackage can be left out; anything else that is missing is an error.
    if not (e.name or "").startswith(("chunkrank.llm", "corpus_pipeline")):
        raise
    llm = None


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in REGISTERED} | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | (llm.oracle_sql() if llm else {})
