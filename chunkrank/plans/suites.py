"""Suites: many data sets, lengths or chunk sizes evaluated by one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkrank.operators.analysis import mean_by_task
from chunkrank.plans.evaluate import evaluate
from chunkrank.schema import RetrievalSet
from chunkrank.session import materialised
from chunkrank.sources import registry, sinks


def length_suite_metrics(
    data: RetrievalSet, tasks: Sequence[str] = registry.MULTI_LENGTH_TASKS, **options
) -> DataFrame:
    """Metrics of every data set, plus ``<task>_avg`` over the lengths of each given task."""
    metrics = evaluate(data, **options)
    task = F.regexp_extract("dataset", r"^(.*)_\d+$", 1)
    return mean_by_task(metrics, F.when(task.isin(list(tasks)), task))


def run_suites(
    spark: SparkSession,
    base: str,
    save_dir: str,
    model_path: str,
    model_name: str,
    method: str,
    names: Sequence[str] | None = None,
    chunk_sizes: Sequence[int] = (),
    triple_tasks: Sequence[str] = (),
    length_tasks: Sequence[str] = (),
    use_prefix: bool = False,
    extended_context: bool = False,
    colbert_model: bool = False,
    known: dict[str, dict[str, str]] = registry.CHUNKED_DATASETS,
    fmt: str = "parquet",
    **options,
) -> tuple[str, list[str]]:
    """Evaluate the main data sets and any further suites, saving each as it is done.

    Returns where the results are and which names were skipped as unknown.
    """
    options = {**options, "method": method, "runtime": True}
    if method != "bm25":
        options |= {"add_prefix": use_prefix, "extended_context": extended_context}
    spent = 0.0

    def saved(metrics: DataFrame, suite: str) -> str:
        """Write a suite, and the description of the run with the seconds of all suites so far."""
        nonlocal spent
        metrics = materialised(metrics)
        own = metrics.filter("metric = 'runtime' and dataset not like '%\\_avg'")
        spent += own.agg(F.sum("value")).first()[0] or 0.0
        about = sinks.run_metadata(
            spark, model_path, model_name, method, extended_context, use_prefix, colbert_model, runtime=spent
        )
        return sinks.write_metrics(metrics, about, save_dir, model_name, method, suite)

    main, skipped = registry.load_chunked_suite(spark, base, names, known, fmt)
    target = saved(evaluate(main, **options), "main")
    if chunk_sizes:
        saved(evaluate(registry.load_chunk_size_suite(spark, base, chunk_sizes, fmt), **options), "chunk_sizes")
    if triple_tasks:
        data = registry.load_triple_suite(spark, f"{base}/nanobeir", triple_tasks, fmt=fmt)
        saved(evaluate(data, **options), "triples")
    if length_tasks:
        data = registry.load_length_suite(spark, f"{base}/LongEmbed", length_tasks, fmt=fmt)
        saved(length_suite_metrics(data, **options), "lengths")
    return target, skipped
