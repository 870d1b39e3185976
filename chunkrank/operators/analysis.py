"""Corpus analyses on top of a scored run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkrank.functions import ids
from chunkrank.operators import trials
from chunkrank.operators.metrics import (
    PLACES,
    macro_metrics,
    metrics_of_labels,
    per_query_metrics,
    rank_run,
    to_long,
)
from chunkrank.operators.topk import CHUNK, PARENT, best_targets, rank_targets
from chunkrank.operators.views import label_positions
from chunkrank.session import materialised

# Numbers of sampled parents, and the trials made for each.
SAMPLE_SIZES = (1, 2, 5, 10, 20, 50, 100, 150, 200)

DRAW_TASKS_PER_CORE = 4
DIGESTS_PER_TASK = 200_000


def trials_for(size: int) -> int:
    return int(500 / size**0.5)


def parent_labels(qrels: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    return qrels.select(
        *keys, "query_id", ids.parent_id(F.col("target_id")).alias("target_id")
    ).distinct()


def labels_by_level(qrels: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Labels for both levels of a run: chunk ids, and the ids of their parents."""
    level = F.explode(F.array(F.lit(CHUNK), F.lit(PARENT)))
    target = F.when(F.col("level") == PARENT, ids.parent_id(F.col("target_id")))
    return (
        qrels.select(*keys, "query_id", "target_id", level.alias("level"))
        .withColumn("target_id", target.otherwise(F.col("target_id")))
        .distinct()
    )


def parent_scores(
    scores: DataFrame, keys: Sequence[str] = ("dataset",), ignore_identical_ids: bool = True
) -> DataFrame:
    """Best chunk score of every parent, from all chunks of a supplied run, before any cut."""
    if ignore_identical_ids:
        scores = scores.filter(F.col("query_id") != F.col("target_id"))
    return scores.groupBy(
        *keys, "query_id", ids.parent_id(F.col("target_id")).alias("target_id")
    ).agg(F.max("score").alias("score"))


def parent_max_metrics(
    scores: DataFrame,
    qrels: DataFrame,
    keys: Sequence[str] = ("dataset",),
    ignore_identical_ids: bool = True,
) -> DataFrame:
    """nDCG@10 over parents for a supplied run."""
    run = rank_run(parent_scores(scores, keys, ignore_identical_ids), keys, 10, ignore_identical_ids)
    each = per_query_metrics(run, parent_labels(qrels, keys), keys, (10,))
    return macro_metrics(each, keys, ["ndcg_at_10"]).withColumn("metric", F.lit("ndcg_at_10_maxsim"))


def _position_means(sliced: DataFrame) -> DataFrame:
    grouped = sliced.groupBy("dataset", "position").agg(
        F.bround(F.avg("ndcg_at_10"), PLACES).alias("ndcg_at_10_at_"),
        F.count("*").cast("double").alias("support_at_"),
    )
    long = to_long(grouped, ["dataset", "position"], ["ndcg_at_10_at_", "support_at_"])
    return long.select("dataset", F.concat("metric", "position").alias("metric"), "value")


def positional_metrics(per_query: DataFrame, qrels: DataFrame) -> DataFrame:
    """nDCG@10 and query count for every position of the first label.

    nDCG belongs to a query, so no slice is evaluated again.
    """
    return _position_means(per_query.join(label_positions(qrels), ["dataset", "query_id"]))


# --- corpus-size scaling -----------------------------------------------------------------


def _digest(seed: int, parent: Column) -> Column:
    return F.md5(
        F.concat_ws(":", F.lit(str(seed)), F.col("n").cast("string"), F.col("trial").cast("string"), parent)
    )


def _threshold(size: Column, parents: Column) -> Column:
    """15 hex digits below which far more than ``size`` of the parents' digests fall."""
    wanted = size + 8 * F.sqrt(size) + 30
    share = F.least(F.lit(1.0), wanted / parents)
    return F.when(share >= 1.0, F.lit("g")).otherwise(
        F.lpad(F.hex((share * F.lit(float(16**15))).cast("long")), 15, "0")
    )


def scaling_samples(
    corpus: DataFrame, sizes: Sequence[int] = SAMPLE_SIZES, seed: int = 42
) -> DataFrame:
    """(dataset, n, trial, parent): for each trial the n parents with the smallest digest.

    Every parent is hashed once per trial, but only those under a generous threshold are
    sorted. Should the threshold leave a trial short, that trial is drawn from all parents.
    """
    digests = sum(trials_for(n) for n in sizes)
    # Written once: every step below starts from the parents, not from the chunks.
    parents = materialised(corpus.select("dataset", ids.parent_id(F.col("chunk_id")).alias("parent")).distinct())
    # A row is small but stands for all its trials: more tasks than its bytes suggest.
    most = DRAW_TASKS_PER_CORE * corpus.sparkSession.sparkContext.defaultParallelism
    parents = parents.repartition(min(most, 1 + parents.count() * digests // DIGESTS_PER_TASK))
    totals = parents.groupBy("dataset").agg(F.count("*").alias("parents"))
    plan = F.array(*[F.struct(F.lit(int(n)).alias("n"), F.lit(trials_for(n)).alias("trials")) for n in sizes])
    # One row per (data set, size): at most len(sizes) rows per data set, so they are broadcast.
    trials = (
        totals.select("dataset", "parents", F.inline(plan))
        .filter(F.col("n") <= F.col("parents"))
        .withColumn("limit", F.lower(_threshold(F.col("n"), F.col("parents"))))
    )
    numbered = F.explode(F.sequence(F.lit(0), F.col("trials") - 1)).alias("trial")
    drawn = (
        parents.join(F.broadcast(trials), "dataset")
        .select("dataset", "parent", "n", "limit", numbered)
        .withColumn("digest", _digest(seed, F.col("parent")))
    )
    first = Window.partitionBy("dataset", "n", "trial").orderBy("digest", "parent")

    def smallest(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("place", F.row_number().over(first))
            .filter((F.col("place") <= max(sizes)) & (F.col("place") <= F.col("n")))
            .select("dataset", "n", "trial", "parent")
        )

    likely = materialised(smallest(drawn.filter(F.substring("digest", 1, 15) < F.col("limit"))))
    full = likely.groupBy("dataset", "n", "trial").agg(F.count("*").alias("found")).filter("found = n")
    every = trials.select("dataset", "n", numbered)
    short = every.join(full, ["dataset", "n", "trial"], "left_anti")
    if short.isEmpty():
        return likely
    again = smallest(drawn.join(F.broadcast(short), ["dataset", "n", "trial"], "left_semi"))
    return materialised(likely.join(short, ["dataset", "n", "trial"], "left_anti").unionByName(again))


TRIAL = trials.TRIAL
SMALL_SAMPLES = 1_000_000


def broadcast_if_small(samples: DataFrame) -> DataFrame:
    """The draw's size is set by the sampling plan (27,621 rows per data set), not the corpus.

    It is materialised already, so counting it before broadcasting costs next to nothing.
    """
    return F.broadcast(samples) if samples.count() <= SMALL_SAMPLES else samples


def sampled(rows: DataFrame, samples: DataFrame, id_name: str) -> DataFrame:
    """Rows whose parent takes part in a trial, once per trial."""
    tagged = rows.withColumn("parent", ids.parent_id(F.col(id_name)))
    return tagged.join(samples, ["dataset", "parent"]).drop("parent")


def trial_labels(qrels: DataFrame, samples: DataFrame) -> DataFrame:
    """Labels of the sampled parents, once per trial; written, as several steps start from them."""
    return materialised(sampled(qrels, samples, "target_id").select(*TRIAL, "query_id", "target_id"))


def scaling_metrics(run: DataFrame, labels: DataFrame, samples: DataFrame) -> DataFrame:
    """Mean nDCG@10 over the trials of each size.

    ``run`` and ``labels`` are already restricted to the trials. A trial is rounded, the mean
    over trials is not; trials without any query are left out and counted.
    """
    return _trial_means(per_query_metrics(run, labels, TRIAL, (10,)), samples)


def _trial_means(each: DataFrame, samples: DataFrame) -> DataFrame:
    by_trial = each.groupBy(*TRIAL).agg(F.bround(F.avg("ndcg_at_10"), PLACES).alias("value"))
    sizes = samples.select(*TRIAL).distinct().join(by_trial, list(TRIAL), "left")
    means = sizes.groupBy("dataset", "n").agg(
        F.avg("value").alias("ndcg_at_10_sample_"),
        F.count(F.when(F.col("value").isNull(), 1)).cast("double").alias("empty_trials_"),
    )
    long = to_long(means, ["dataset", "n"], ["ndcg_at_10_sample_", "empty_trials_"])
    return long.select("dataset", F.concat("metric", F.col("n").cast("string")).alias("metric"), "value")


def scale_scored(
    queries: DataFrame,
    chunks: DataFrame,
    qrels: DataFrame,
    scorer,
    sizes: Sequence[int] = SAMPLE_SIZES,
    seed: int = 42,
    ignore_identical_ids: bool = True,
    form: str = "auto",
) -> DataFrame:
    """Scaling of a scorer, by the cheaper of two plans with the same ranks.

    once   Every pair of an asked query and a sampled chunk is scored once; see ``trials``.
    trial  Each trial's queries meet its own chunks, every trial a key of one top-k job. A trial holds
           at most ``max(sizes)`` parents, so this is bounded by the sampling plan and not by
           queries x corpus.

    ``form`` names one of them; else both are counted out, and the one that scores fewer pairs is taken
    if its labels and queries fit a task.
    """
    draw = scaling_samples(chunks, sizes, seed)
    samples = broadcast_if_small(draw)
    labels = trial_labels(qrels, samples)
    if form in ("auto", "once"):
        offered = trials.offered_by_trial(chunks, samples)
        cost = trials.costs(offered, labels, queries, chunks, draw, scorer)
        if form == "once" or (cost.fits and cost.once <= cost.by_trial and draw.count() <= SMALL_SAMPLES):
            ranks = trials.label_ranks(queries, chunks, labels, draw, offered, scorer, ignore_identical_ids)
            return _trial_means(metrics_of_labels(ranks, TRIAL, (10,)), draw)
    asked = labels.select(*TRIAL, "query_id").distinct().join(queries, ["dataset", "query_id"])
    offered = sampled(chunks, samples, "chunk_id")
    found = best_targets(asked, offered, scorer, TRIAL, k=10, ignore_identical_ids=ignore_identical_ids, form="grid")
    return scaling_metrics(rank_targets(found, TRIAL, 10).drop("level"), labels, samples)


def scale_run(
    scores: DataFrame,
    corpus: DataFrame,
    qrels: DataFrame,
    sizes: Sequence[int] = SAMPLE_SIZES,
    seed: int = 42,
    ignore_identical_ids: bool = True,
) -> DataFrame:
    """Scaling of a supplied run. Per query and parent only the ten best chunks can matter."""
    samples = broadcast_if_small(scaling_samples(corpus, sizes, seed))
    labels = trial_labels(qrels, samples)
    parent = scores.withColumn("parent", ids.parent_id(F.col("target_id")))
    best = rank_run(parent, ("dataset", "parent"), 10, ignore_identical_ids).drop("rank")
    asked = labels.select(*TRIAL, "query_id").distinct()
    run = best.join(samples, ["dataset", "parent"]).join(asked, [*TRIAL, "query_id"])
    return scaling_metrics(rank_run(run, TRIAL, 10, False), labels, samples)


def mean_by_task(metrics: DataFrame, task: Column) -> DataFrame:
    """Adds ``<task>_avg``: the unweighted mean of every metric over a task's data sets.

    ``task`` is null for data sets without an average. Each value counts once under its own
    name and once under the task's, so the metrics are computed once.
    """
    average = F.concat(task, F.lit("_avg"))
    return (
        metrics.select(
            F.explode(F.array_compact(F.array(F.col("dataset"), average))).alias("dataset"),
            "metric",
            "value",
        )
        .groupBy("dataset", "metric")
        .agg(F.avg("value").alias("value"))
    )
