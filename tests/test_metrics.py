"""Hand-worked metric cases, tie rules and properties."""

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chunkrank.operators import metrics

RUN = "dataset string, query_id string, target_id string, score double"
LABELS = "dataset string, query_id string, target_id string, label_pos int"


def run_of(spark, scored):
    return spark.createDataFrame([("d", q, t, float(s)) for q, t, s in scored], RUN)


def labels_of(spark, pairs):
    return spark.createDataFrame([("d", q, t, i) for i, (q, t) in enumerate(pairs)], LABELS)


def per_query(spark, scored, pairs, ks=metrics.CUTOFFS, **options):
    ranked = metrics.rank_run(run_of(spark, scored), **options)
    found = metrics.per_query_metrics(ranked, labels_of(spark, pairs), ks=ks).collect()
    return {r.query_id: r.asDict() for r in found}


def test_two_labels_found_late(spark):
    got = per_query(spark, [("q", "x", 3), ("q", "a", 2), ("q", "b", 1)], [("q", "a"), ("q", "b")])["q"]
    assert got["map_at_10"] == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert got["ndcg_at_10"] == pytest.approx((1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3)))
    assert round(got["ndcg_at_10"], 5) == 0.69343
    assert got["recall_at_1"] == 0 and got["precision_at_10"] == 0.2


def test_ties_go_to_the_larger_id(spark):
    got = per_query(spark, [("q", "a", 1), ("q", "b", 1)], [("q", "a")])["q"]
    assert round(got["ndcg_at_10"], 5) == 0.63093
    ranked = metrics.rank_run(run_of(spark, [("q", "10_0", 1), ("q", "1_0", 1)]))
    assert [r.target_id for r in ranked.orderBy("rank").collect()] == ["1_0", "10_0"]


def test_scores_tie_after_rounding(spark):
    ranked = metrics.rank_run(run_of(spark, [("q", "a", 0.12345649), ("q", "b", 0.12345641)]))
    assert ranked.orderBy("rank").first().target_id == "b"


def test_more_labels_than_k_and_few_results(spark):
    got = per_query(spark, [("q", "a", 2), ("q", "x", 1)], [("q", "a"), ("q", "b"), ("q", "c")])["q"]
    assert got["ndcg_at_1"] == 1
    assert got["recall_at_1"] == pytest.approx(1 / 3)
    assert got["map_at_1"] == pytest.approx(1 / 3)
    assert got["precision_at_5"] == pytest.approx(0.2)


def test_query_without_a_hit_counts_and_outsiders_do_not(spark):
    scored = [("hit", "a", 1), ("miss", "x", 1), ("unlabelled", "a", 1)]
    pairs = [("hit", "a"), ("miss", "b"), ("unscored", "a")]
    got = per_query(spark, scored, pairs)
    assert set(got) == {"hit", "miss"}
    assert all(v == 0 for n, v in got["miss"].items() if "_at_" in n)
    ranked = metrics.rank_run(run_of(spark, scored))
    means = metrics.macro_metrics(metrics.per_query_metrics(ranked, labels_of(spark, pairs)))
    assert dict(rows(means, "metric", "value"))["ndcg_at_10"] == 0.5


def test_means_round_half_to_even(spark):
    scored = [(f"q{i}", "a" if i == 0 else "x", 1) for i in range(64)]
    pairs = [(f"q{i}", "a") for i in range(64)]
    ranked = metrics.rank_run(run_of(spark, scored))
    means = metrics.macro_metrics(metrics.per_query_metrics(ranked, labels_of(spark, pairs)))
    assert dict(rows(means, "metric", "value"))["precision_at_1"] == 0.01562


def test_identical_ids(spark):
    scored = [("12", "12", 9), ("12", "a", 1)]
    assert per_query(spark, scored, [("12", "a")])["12"]["ndcg_at_1"] == 1
    assert per_query(spark, scored, [("12", "a")], ignore_identical_ids=False)["12"]["ndcg_at_1"] == 0


def test_repeated_labels_collapse(spark):
    got = per_query(spark, [("q", "a", 1)], [("q", "a"), ("q", "a")])["q"]
    assert got["recall_at_1"] == 1


def reference_measures(ranking, relevant, k):
    hits = [i + 1 for i, t in enumerate(ranking[:k]) if t in relevant]
    ideal = sum(1 / math.log2(i + 1) for i in range(1, min(len(relevant), k) + 1))
    return {
        "ndcg": sum(1 / math.log2(r + 1) for r in hits) / ideal,
        "map": sum((i + 1) / r for i, r in enumerate(hits)) / len(relevant),
        "recall": len(hits) / len(relevant),
        "precision": len(hits) / k,
    }


def test_random_runs_match_the_definitions(spark):
    rng = random.Random(7)
    scored, pairs, expected = [], [], {}
    for q in range(12):
        targets = [f"t{i}" for i in range(rng.randint(3, 160))]
        scores = {t: rng.choice([0.0, 0.25, rng.random()]) for t in targets}
        relevant = set(rng.sample(targets, min(len(targets), rng.randint(1, 20)))) | {"absent"}
        scored += [(f"q{q}", t, s) for t, s in scores.items()]
        pairs += [(f"q{q}", t) for t in relevant]
        # stable: ids descending first, then scores descending
        ranking = sorted(sorted(targets, reverse=True), key=lambda t: -round(scores[t], 6))
        expected[f"q{q}"] = (ranking, relevant)
    got = per_query(spark, scored, pairs)
    for q, (ranking, relevant) in expected.items():
        for k in metrics.CUTOFFS:
            for measure, value in reference_measures(ranking, relevant, k).items():
                assert got[q][f"{measure}_at_{k}"] == pytest.approx(value), (q, measure, k)
        recalls = [got[q][f"recall_at_{k}"] for k in metrics.CUTOFFS]
        assert recalls == sorted(recalls)


def test_low_scored_extras_change_nothing(spark):
    base = [("q", f"t{i:03}", 1000 - i) for i in range(100)]
    extra = [("q", f"u{i:03}", -i - 1) for i in range(50)]
    pairs = [("q", "t003"), ("q", "t090"), ("q", "u001")]
    assert per_query(spark, base, pairs) == per_query(spark, base + extra, pairs)


def test_wide_and_long(spark):
    ranked = metrics.rank_run(run_of(spark, [("q", "a", 1)]))
    means = metrics.macro_metrics(metrics.per_query_metrics(ranked, labels_of(spark, [("q", "a")])))
    assert means.count() == 20
    wide = metrics.to_wide(means, metrics.metric_names())
    assert wide.first()["recall_at_100"] == 1.0
    assert wide.select(F.col("dataset")).first()[0] == "d"
