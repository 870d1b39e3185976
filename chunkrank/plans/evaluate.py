"""End-to-end evaluation: texts or vectors in, long metrics out, for many data sets at once."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkrank.functions.text import DOCUMENT_PROMPT, QUERY_PROMPT
from chunkrank.operators import bm25, checks, encode
from chunkrank.operators.analysis import (
    SAMPLE_SIZES,
    labels_by_level,
    parent_labels,
    scale_scored,
)
from chunkrank.operators.metrics import CUTOFFS, PLACES, metric_names, per_query_metrics, to_long
from chunkrank.operators.scorers import Bm25, Dense, MaxSim
from chunkrank.operators.timing import Stopwatch, stopwatch
from chunkrank.operators.topk import CHUNK, PARENT, candidates, rank_targets
from chunkrank.operators.views import label_positions, with_prompts
from chunkrank.schema import RetrievalSet, require_columns
from chunkrank.session import materialised

# method: (token vectors, chunks of a document encoded together)
VECTOR_METHODS = {
    "dense": (False, False),
    "sentence_transformer": (False, False),
    "contextual": (False, True),
    "maxsim": (True, False),
    "colbert": (True, False),
    "late_interaction": (True, True),
    "li": (True, True),
}
PARENT_DEPTH = 10  # only nDCG@10 is reported for parents


@dataclass(frozen=True)
class Scored:
    """Both sides in the form a scorer reads, with the labels that go with them."""

    queries: DataFrame
    chunks: DataFrame
    qrels: DataFrame
    scorer: object
    runtime: Callable[[], dict[str, float]] | None = None  # seconds of encoding or indexing, by data set


def dense(data: RetrievalSet, mean_over_docs: bool = False) -> Scored:
    """``vector`` columns, compared by raw dot product."""
    require_columns(data.queries, "vector")
    require_columns(data.corpus, "vector")
    if mean_over_docs:
        return Scored(
            data.queries, encode.mean_over_documents(data.corpus), parent_labels(data.qrels), Dense()
        )
    return Scored(data.queries, data.corpus, data.qrels, Dense())


def maxsim(data: RetrievalSet, pad_floor: bool = False) -> Scored:
    """``token_vectors`` columns, compared by late interaction."""
    require_columns(data.queries, "token_vectors")
    require_columns(data.corpus, "token_vectors")
    chunks = encode.mark_padded(data.corpus) if pad_floor else data.corpus
    return Scored(data.queries, chunks, data.qrels, MaxSim(pad_floor))


def lexical(
    data: RetrievalSet,
    k1: float = bm25.K1,
    b: float = bm25.B,
    epsilon: float = bm25.EPSILON,
    sentinels: Sequence[str] = (),
) -> Scored:
    """``text`` (or ``tokens``) columns, compared by BM25."""
    corpus = bm25.tokenised(data.corpus, sentinels)
    queries = bm25.tokenised(data.queries, sentinels)
    start = time.perf_counter()
    counts = bm25.term_counts(corpus)
    seconds = time.perf_counter() - start
    # Small next to the index it is joined from, and read by every later step.
    weighted = materialised(bm25.weighted_queries(queries, counts, epsilon))
    return Scored(weighted, corpus, data.qrels, Bm25(k1, b), lambda: shared_out(seconds, counts))


def shared_out(seconds: float, counts: DataFrame) -> dict[str, float]:
    """The time of one index over many data sets, to each by its share of the tokens.

    The index is one pass inside the JVM, where nothing tells the data sets apart but their rows.
    """
    sizes = {r.dataset: r.total or 0 for r in counts.filter("term is null").select("dataset", "total").collect()}
    whole = sum(sizes.values()) or 1
    return {name: seconds * size / whole for name, size in sizes.items()}


def encoded(
    data: RetrievalSet,
    factory: encode.EncoderFactory,
    contextual_factory=None,
    token_level: bool = False,
    add_prefix: bool = False,
    batch_size: int = 128,
    max_tokens: int | None = None,
    extended_context: bool = False,
    watch: Stopwatch | None = None,
) -> RetrievalSet:
    """Run a plug-in over queries and chunks; with ``contextual_factory`` chunks go by document.

    ``max_tokens`` and ``extended_context`` are settled with the factories; ``watch`` sums the seconds of
    the chunks.
    """
    limits = {"max_tokens": max_tokens, "extended_context": extended_context}
    queries = encode.encode(
        data.queries,
        factory,
        prompt=QUERY_PROMPT if add_prefix else "",
        batch_size=batch_size,
        token_level=token_level,
        **limits,
    )
    if contextual_factory is None:
        corpus = encode.encode(
            data.corpus,
            factory,
            prompt=DOCUMENT_PROMPT if add_prefix else "",
            batch_size=batch_size,
            token_level=token_level,
            watch=watch,
            **limits,
        )
    else:
        corpus = encode.encode_in_context(
            data.corpus,
            contextual_factory,
            prompt=DOCUMENT_PROMPT if add_prefix else "",
            token_level=token_level,
            watch=watch,
            **limits,
        )
    return data.but(queries=queries, corpus=corpus)


def scored_by(
    data: RetrievalSet,
    method: str | Callable[[RetrievalSet], Scored],
    factory: encode.EncoderFactory | None = None,
    contextual_factory=None,
    add_prefix: bool = False,
    batch_size: int = 128,
    mean_over_docs: bool = False,
    max_tokens: int | None = None,
    extended_context: bool = False,
    **options,
) -> Scored:
    """Pick a scorer by name, or call one of your own.

    Vectors already present are used as they are; else the plug-in's are computed once and
    written, as encoding costs far more than reading.
    """
    if callable(method):
        return method(data, **options)
    if method == "bm25":
        return lexical(data, **options)
    if method == "merged_contextual":
        raise NotImplementedError("merged contextual vectors have no document encoder")
    if method not in VECTOR_METHODS:
        raise ValueError(f"unknown method: {method}")
    late, by_document = VECTOR_METHODS[method]
    runtime = None
    if ("token_vectors" if late else "vector") not in data.corpus.columns:
        context = contextual_factory if by_document else None
        if factory is None:
            raise ValueError(f"{method} needs a factory for the queries and chunks to encode")
        if by_document and context is None:
            raise ValueError(f"{method} needs a contextual_factory for the chunks of a document")
        watch = stopwatch(data.corpus.sparkSession)
        data = encoded(data, factory, context, late, add_prefix, batch_size, max_tokens, extended_context, watch)
        data = data.but(corpus=materialised(data.corpus), queries=materialised(data.queries))
        seconds = dict(watch.value)
        runtime = lambda: seconds
    scored = maxsim(data, **options) if late else dense(data, mean_over_docs)
    return replace(scored, runtime=runtime)


def with_positional_ids(data: RetrievalSet) -> RetrievalSet:
    """Name every query by its row number, as tools that count queries do.

    A query then shadows a chunk (or parent) that happens to carry the same number.
    """
    number = F.col("query_pos").cast("string")
    names = data.queries.select("dataset", "query_id", number.alias("_number"))
    return data.but(
        queries=data.queries.withColumn("query_id", number),
        qrels=data.qrels.join(names, ["dataset", "query_id"])
        .withColumn("query_id", F.col("_number"))
        .drop("_number"),
    )


def ranked(
    scored: Scored,
    k: int = max(CUTOFFS),
    parents: bool = False,
    ignore_identical_ids: bool = True,
    form: str = "auto",
    with_floors: bool | None = None,
) -> DataFrame:
    """The run: the best ``k`` chunks of each query and, on request, its best parents."""
    depth = PARENT_DEPTH if parents else 0
    found, rows = candidates(
        scored.queries,
        scored.chunks,
        scored.scorer,
        k=k,
        parent_k=depth,
        ignore_identical_ids=ignore_identical_ids,
        form=form,
        with_floors=with_floors,
    )
    return rank_targets(found, k=k, parent_k=depth, rows=rows)


def summarise(
    run: DataFrame,
    qrels: DataFrame,
    ks: Sequence[int] = CUTOFFS,
    positional: bool = False,
    parents: bool = True,
) -> DataFrame:
    """All means of a run in one pass: overall, per parent level and per label position."""
    keys = ["dataset", "level"]
    labels = labels_by_level(qrels) if parents else qrels.withColumn("level", F.lit(CHUNK))
    depths = sorted({*ks, PARENT_DEPTH}) if parents or positional else sorted(ks)
    each = per_query_metrics(run, labels, keys, depths)
    if positional:
        at = F.when(F.col("level") == CHUNK, F.col("position"))
        each = each.join(label_positions(qrels), ["dataset", "query_id"], "left").withColumn(
            "slice", F.explode(F.array_compact(F.array(F.lit(""), at)))
        )
    else:
        each = each.withColumn("slice", F.lit(""))
    names = metric_names(depths)
    means = each.groupBy(*keys, "slice").agg(
        *[F.bround(F.avg(n), PLACES).alias(n) for n in names],
        F.count("*").cast("double").alias("support"),
    )
    rows = to_long(means, [*keys, "slice"], [*names, "support"])
    whole = (F.col("level") == CHUNK) & (F.col("slice") == "")
    at_slice = (F.col("level") == CHUNK) & (F.col("slice") != "")
    name = (
        F.when(whole & F.col("metric").isin(metric_names(ks)), F.col("metric"))
        .when(at_slice & (F.col("metric") == "ndcg_at_10"), F.concat(F.lit("ndcg_at_10_at_"), "slice"))
        .when(at_slice & (F.col("metric") == "support"), F.concat(F.lit("support_at_"), "slice"))
        .when((F.col("level") == PARENT) & (F.col("metric") == "ndcg_at_10"), F.lit("ndcg_at_10_maxsim"))
    )
    return rows.select("dataset", name.alias("metric"), "value").filter(F.col("metric").isNotNull())


def require_sound(data: RetrievalSet) -> None:
    """Fail on labels outside the corpus and on queries without labels."""
    missing = checks.label_violations(data.qrels, data.corpus).first()
    if missing is not None:
        raise ValueError(f"label not in the corpus: {missing.asDict()}")
    bare = checks.unlabelled_queries(data.queries, data.qrels).first()
    if bare is not None:
        raise ValueError(f"query without a label: {bare.asDict()}")


def without_earlier_copies(corpus: DataFrame, check: bool = True) -> DataFrame:
    """Of chunks that share an id the last one counts, by ``chunk_pos``, which every reader supplies.

    A table without that column has no last one: with ``check`` repeated ids are an error.
    """
    if "chunk_pos" in corpus.columns:
        return checks.keep_last(corpus, "chunk_pos")
    if check:
        twice = checks.duplicate_ids(corpus).first()
        if twice is not None:
            raise ValueError(f"chunk id occurs more than once, and no chunk_pos tells the last: {twice.asDict()}")
    return corpus


def evaluate(
    data: RetrievalSet,
    method: str | Callable[[RetrievalSet], Scored] = "dense",
    compute_positional_metrics: bool = False,
    max_sim_over_docs: bool = True,
    run_scaling_laws: bool = False,
    mean_over_docs: bool = False,
    ks: Sequence[int] = CUTOFFS,
    ignore_identical_ids: bool = True,
    compat_positional_ids: bool = False,
    check: bool = True,
    runtime: bool = False,
    form: str = "auto",
    sizes: Sequence[int] = SAMPLE_SIZES,
    seed: int = 42,
    **method_options,
) -> DataFrame:
    """Rows (dataset, metric, value). ``mean_over_docs`` applies to dense vectors only.

    ``runtime`` adds the seconds that tasks spent encoding or indexing each data set's chunks.
    """
    data = data.but(corpus=without_earlier_copies(data.corpus, check))
    if check:
        require_sound(data)
    if compat_positional_ids:
        data = with_positional_ids(data)
    data = with_prompts(data, by_document=method in VECTOR_METHODS and VECTOR_METHODS[method][1])
    scored = scored_by(data, method, mean_over_docs=mean_over_docs, **method_options)
    run = ranked(scored, max(ks), max_sim_over_docs, ignore_identical_ids, form)
    metrics = summarise(run, scored.qrels, ks, compute_positional_metrics, max_sim_over_docs)
    if run_scaling_laws:
        metrics = metrics.unionByName(
            scale_scored(
                scored.queries,
                scored.chunks,
                scored.qrels,
                scored.scorer,
                sizes,
                seed,
                ignore_identical_ids,
            )
        )
    if runtime and scored.runtime is not None:
        rows = [(name, "runtime", seconds) for name, seconds in scored.runtime().items()]
        metrics = metrics.unionByName(
            metrics.sparkSession.createDataFrame(rows, "dataset string, metric string, value double")
        )
    return metrics
