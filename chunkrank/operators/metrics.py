"""nDCG, MAP, recall and precision of a ranked run, per query and averaged.

A run holds at most max(k) rows per query, so everything here is small next to scoring. Labels
meet the run on (query, target), which no single busy query can skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The cut-offs every suite reports.
CUTOFFS = (1, 5, 10, 50, 100)
MEASURES = ("ndcg", "map", "recall", "precision")
PLACES = 5


def metric_names(ks: Sequence[int] = CUTOFFS) -> list[str]:
    return [f"{measure}_at_{k}" for measure in MEASURES for k in ks]


def rank_run(
    scores: DataFrame,
    keys: Sequence[str] = ("dataset",),
    k: int = 100,
    ignore_identical_ids: bool = True,
    float_scores: bool = False,
) -> DataFrame:
    """Rank a run supplied as rows (keys, query_id, target_id, score).

    Scores are compared after rounding to 6 places, or as 32-bit floats on request; ties go
    to the larger id. The cut runs before and after the shuffle.
    """
    if ignore_identical_ids:
        scores = scores.filter(F.col("query_id") != F.col("target_id"))
    score = F.col("score").cast("float").cast("double") if float_scores else F.round("score", 6)
    order = Window.partitionBy(*keys, "query_id").orderBy(F.desc("score"), F.desc("target_id"))
    return (
        scores.select(
            *keys,
            F.col("query_id").cast("string").alias("query_id"),
            F.col("target_id").cast("string").alias("target_id"),
            score.alias("score"),
        )
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def _measures(k: int) -> dict[str, Column]:
    """The four measures at one cut-off from ``ranks`` (of the hits, ascending) and ``relevant``.

    As SQL text: one expression each, where building them from columns costs a call per node.
    """
    gain = "aggregate({0}, 0D, (total, r) -> total + 1D / log2(r + 1))"
    found = f"filter(ranks, r -> r <= {k})"
    ideal = gain.format(f"sequence(1, least(int(relevant), {k}))")
    precisions = f"aggregate(transform({found}, (r, i) -> (i + 1D) / r), 0D, (total, p) -> total + p)"
    return {
        "ndcg": F.expr(f"{gain.format(found)} / {ideal}"),
        "map": F.expr(f"{precisions} / relevant"),
        "recall": F.expr(f"double(size({found})) / relevant"),
        "precision": F.expr(f"size({found}) / {k}D"),
    }


def per_query_metrics(
    run: DataFrame,
    qrels: DataFrame,
    keys: Sequence[str] = ("dataset",),
    ks: Sequence[int] = CUTOFFS,
) -> DataFrame:
    """One row per query that is in both the run and the labels, one column per metric."""
    query = [*keys, "query_id"]
    labels = qrels.select(*query, "target_id").distinct()
    relevant = labels.groupBy(*query).agg(F.count("*").alias("relevant"))
    hits = (
        run.select(*query, "target_id", "rank")
        .join(labels.withColumn("_hit", F.lit(True)), [*query, "target_id"], "left")
        .groupBy(*query)
        # At most max(k) ranks per query; nulls of the misses are not collected.
        .agg(F.sort_array(F.collect_list(F.when(F.col("_hit"), F.col("rank")))).alias("ranks"))
    )
    return measured(hits.join(relevant, query), query, ks)


def measured(hits: DataFrame, query: Sequence[str], ks: Sequence[int] = CUTOFFS) -> DataFrame:
    """The metrics of each query from ``ranks`` (of its hits, ascending) and ``relevant`` (its labels)."""
    at = {k: _measures(k) for k in ks}
    return hits.select(*query, *[at[k][measure].alias(f"{measure}_at_{k}") for measure in MEASURES for k in ks])


def metrics_of_labels(ranks: DataFrame, keys: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """The same from one row per label, (keys, query_id, rank), with a null rank where it was not found."""
    query = [*keys, "query_id"]
    hits = ranks.groupBy(*query).agg(
        # At most max(k) labels have such ranks.
        F.sort_array(F.collect_list(F.when(F.col("rank") <= max(ks), F.col("rank")))).alias("ranks"),
        F.count(F.lit(1)).alias("relevant"),
    )
    return measured(hits, query, ks)


def macro_metrics(
    per_query: DataFrame, keys: Sequence[str] = ("dataset",), names: Sequence[str] | None = None
) -> DataFrame:
    """Means over queries, rounded half-even to 5 places: rows (keys, metric, value)."""
    names = list(names or [c for c in per_query.columns if "_at_" in c])
    means = per_query.groupBy(*keys).agg(*[F.bround(F.avg(n), PLACES).alias(n) for n in names])
    return to_long(means, keys, names)


def to_long(wide: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(keys), list(names), "metric", "value")


def to_wide(metrics: DataFrame, names: Sequence[str], keys: Sequence[str] = ("dataset",)) -> DataFrame:
    return metrics.groupBy(*keys).pivot("metric", list(names)).agg(F.first("value"))
