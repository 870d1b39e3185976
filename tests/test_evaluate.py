"""End to end: BM25 against a plain implementation, analyses, properties, options."""

import math
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from chunkrank import workloads as w
from chunkrank.operators import analysis, metrics
from chunkrank.operators.encode import HashedTokens
from chunkrank.plans import evaluate as plan
from chunkrank.plans.evaluate import evaluate
from chunkrank.plans.suites import length_suite_metrics
from chunkrank.schema import RetrievalSet
from chunkrank.sources.registry import merge


def values(df):
    return {(r.dataset, r.metric): r.value for r in df.collect()}


def okapi(docs, query, k1=1.5, b=0.75, epsilon=0.25):
    n, lengths = len(docs), [len(d) for d in docs]
    avgdl = sum(lengths) / n
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = epsilon * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(
            sum(
                idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / avgdl))
                for t in query
                if tf[t]
            )
        )
    return out


def text_set(spark, docs, queries, labels):
    corpus = spark.createDataFrame([("d", i, t) for i, t in docs], "dataset string, chunk_id string, text string")
    asked = spark.createDataFrame(
        [("d", i, n, t) for n, (i, t) in enumerate(queries)],
        "dataset string, query_id string, query_pos long, text string",
    )
    qrels = spark.createDataFrame(
        [("d", q, t, n) for n, (q, t) in enumerate(labels)],
        "dataset string, query_id string, target_id string, label_pos int",
    )
    return RetrievalSet(corpus, asked, qrels)


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["the"] * 12 + [f"w{i}" for i in range(30)]
    docs = [(f"{i // 2}_{i % 2}", " ".join(rng.choice(vocabulary, 8 + i % 9))) for i in range(40)]
    queries = [(f"q{i}", " ".join(rng.choice(vocabulary, 6)) + " the") for i in range(10)] + [("q_none", "zzz")]
    labels = [(f"q{i}", docs[3 * i][0]) for i in range(10)] + [("q_none", docs[0][0]), ("q1", docs[7][0])]
    return text_set(spark, docs, queries, labels), docs, queries


@pytest.mark.parametrize("form", ["auto", "grid", "tiles"])
@pytest.mark.parametrize("sentinels", [(), ("[cls]", "[sep]")])
def test_bm25(texts, form, sentinels):
    data, docs, queries = texts
    run = plan.ranked(plan.lexical(data, sentinels=sentinels), k=100, form=form)
    got = {(r.query_id, r.target_id): (r.score, r.rank) for r in run.collect()}
    assert len(got) == len(docs) * len(queries)
    tokens = [t.split() + list(sentinels) for _, t in docs]
    for q, text in queries:
        scores = dict(zip([i for i, _ in docs], okapi(tokens, text.split() + list(sentinels))))
        order = sorted(sorted(scores, reverse=True), key=lambda i: -round(scores[i], 6))
        for rank, target in enumerate(order, 1):
            assert got[q, target][0] == pytest.approx(scores[target], abs=1e-6)
            assert got[q, target][1] == rank


def test_unmatched_query_ranks_by_id_descending(texts):
    data, docs, _ = texts
    run = plan.ranked(plan.lexical(data), k=5).filter("query_id = 'q_none'").orderBy("rank").collect()
    assert [r.target_id for r in run] == sorted([i for i, _ in docs], reverse=True)[:5]
    assert {r.score for r in run} == {0.0}


def complete_run(spark, texts):
    data, docs, queries = texts
    tokens = [t.split() for _, t in docs]
    scored = [
        ("d", q, i, float(s)) for q, text in queries for (i, _), s in zip(docs, okapi(tokens, text.split()))
    ]
    return spark.createDataFrame(scored, "dataset string, query_id string, target_id string, score double")


def test_evaluate_agrees_with_a_supplied_run(spark, texts):
    data = texts[0]
    run = complete_run(spark, texts)
    each = metrics.per_query_metrics(metrics.rank_run(run), data.qrels)
    wanted = values(metrics.macro_metrics(each))
    wanted.update(values(analysis.parent_max_metrics(run, data.qrels)))
    wanted.update(values(analysis.positional_metrics(each, data.qrels)))
    wanted.update(values(analysis.scale_run(run, data.corpus, data.qrels, sizes=(1, 5, 20, 50))))
    got = values(
        evaluate(
            data, "bm25", compute_positional_metrics=True, run_scaling_laws=True, sizes=(1, 5, 20, 50)
        )
    )
    assert got == wanted
    # every parent sampled: each trial is the plain evaluation; 50 parents are more than there are
    assert got["d", "ndcg_at_10_sample_20"] == pytest.approx(got["d", "ndcg_at_10"])
    assert ("d", "ndcg_at_10_sample_50") not in got


def test_repartitioning_changes_nothing(texts):
    data = texts[0]
    once = values(evaluate(data, "bm25", run_scaling_laws=True, sizes=(2,)))
    again = values(evaluate(data.but(corpus=data.corpus.repartition(7)), "bm25", run_scaling_laws=True, sizes=(2,)))
    assert once == again


def test_samples(spark, texts):
    corpus = texts[0].corpus
    drawn = analysis.scaling_samples(corpus, (1, 5, 20))
    counts = drawn.groupBy("n", "trial").agg(F.countDistinct("parent").alias("k"), F.count("*").alias("all"))
    assert counts.filter("k <> n or all <> n").count() == 0
    assert rows(counts.groupBy("n").count()) == [(1, 500), (5, 223), (20, 111)]
    assert [analysis.trials_for(n) for n in analysis.SAMPLE_SIZES] == [500, 353, 223, 158, 111, 70, 50, 40, 35]


def test_short_trials_are_drawn_again(spark, texts, monkeypatch):
    corpus = texts[0].corpus
    whole = rows(analysis.scaling_samples(corpus, (2, 5)), "n", "trial", "parent")
    # a threshold that keeps about one parent per trial leaves most trials short
    monkeypatch.setattr(analysis, "_threshold", lambda size, parents: F.lit("0ccccccccccccccc"))
    assert rows(analysis.scaling_samples(corpus, (2, 5)), "n", "trial", "parent") == whole


def scaled(data, form, sizes=(1, 2, 5, 20), ignore=True):
    scored = plan.lexical(data)
    return values(analysis.scale_scored(scored.queries, scored.chunks, scored.qrels, scored.scorer, sizes, form=form, ignore_identical_ids=ignore))


def test_both_scaling_plans_agree(spark, texts):
    data = texts[0]
    # Ties everywhere, queries with two labels in one document and in two, a label that is no chunk.
    more = spark.createDataFrame(
        [("d", "q2", "0_0", 7), ("d", "q2", "0_1", 8), ("d", "q3", "5_1", 9), ("d", "q3", "5_9", 10), ("d", "q_none", "19_1", 3)],
        data.qrels.schema,
    )
    data = data.but(qrels=data.qrels.unionByName(more))
    once = scaled(data, "once")
    assert once == scaled(data, "trial") == scaled(data, "auto")
    assert len(once) == 8


@pytest.mark.parametrize("ignore", [True, False])
def test_scaling_plans_agree_on_queries_named_like_chunks(spark, ignore):
    docs = [("a_0", "x"), ("b_0", "x y"), ("b_1", "y y"), ("c_0", "x x y"), ("d", "x")]
    queries = [("a_0", "x"), ("b_1", "y"), ("d", "y x"), ("q", "nothing")]
    data = text_set(spark, docs, queries, [("a_0", "a_0"), ("a_0", "c_0"), ("b_1", "b_0"), ("d", "d"), ("q", "c_0")])
    assert scaled(data, "once", (1, 2, 5), ignore) == scaled(data, "trial", (1, 2, 5), ignore)


def test_scaling_scores_once_only_what_is_cheaper_and_fits(spark, texts, monkeypatch):
    from chunkrank.operators import trials

    data = texts[0]
    scored = plan.lexical(data)
    draw = analysis.scaling_samples(scored.chunks, (1, 20))
    labels = analysis.trial_labels(data.qrels, draw)
    offered = trials.offered_by_trial(scored.chunks, draw)
    cost = trials.costs(offered, labels, scored.queries, scored.chunks, draw, scored.scorer)
    asked = labels.select("n", "trial", "query_id").distinct().groupBy("n", "trial").count()
    by_hand = sum(r["count"] * 2 * r["n"] for r in asked.collect())
    assert cost.fits and cost.by_trial == by_hand and cost.once == 11 * 40
    used = []
    monkeypatch.setattr(trials, "label_ranks", lambda *a, **k: used.append(a) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        scaled(data, "auto", (1, 20))
    monkeypatch.setattr(trials, "MOST_LABELS", 3)
    assert scaled(data, "auto", (1, 20)) and len(used) == 1


def test_empty_trials_are_counted(spark):
    docs = [("a_0", "x"), ("b_0", "y")]
    data = text_set(spark, docs, [("q", "x")], [("q", "a_0")])
    got = values(evaluate(data, "bm25", run_scaling_laws=True, sizes=(1, 2)))
    assert 0 < got["d", "empty_trials_1"] < 500 and got["d", "empty_trials_2"] == 0
    assert got["d", "ndcg_at_10_sample_1"] == 1.0


def test_one_chunk_per_document(spark, sf):
    data = w.vectors(spark, sf)
    single = data.but(
        corpus=data.corpus.withColumn("chunk_id", F.regexp_replace("chunk_id", "_", "-")),
        queries=data.queries.withColumn("query_id", F.regexp_replace("query_id", "_", "-")),
        qrels=data.qrels.withColumn("target_id", F.regexp_replace("target_id", "_", "-")).withColumn(
            "query_id", F.regexp_replace("query_id", "_", "-")
        ),
    )
    got = values(evaluate(single))
    assert got["vectors", "ndcg_at_10_maxsim"] == got["vectors", "ndcg_at_10"]
    averaged = values(evaluate(single, mean_over_docs=True))
    assert averaged == got


def test_positional_ids_shadow_namesakes(spark):
    docs = [("0", "x"), ("1", "x y"), ("2", "y")]
    data = text_set(spark, docs, [("first", "x"), ("second", "y")], [("first", "0"), ("second", "2")])
    plain = values(evaluate(data, "bm25"))
    compat = values(evaluate(data, "bm25", compat_positional_ids=True))
    assert plain["d", "recall_at_100"] == 1.0
    # query number 0 can no longer find document 0
    assert compat["d", "recall_at_100"] == 0.5


def test_checks_before_the_run(spark, texts):
    data = texts[0]
    stray = data.qrels.withColumn("target_id", F.lit("nowhere_0"))
    with pytest.raises(ValueError, match="label not in the corpus"):
        evaluate(data.but(qrels=stray), "bm25")
    with pytest.raises(ValueError, match="query without a label"):
        evaluate(data.but(qrels=data.qrels.filter("query_id <> 'q1'")), "bm25")


def test_methods_by_name(spark, texts):
    data = texts[0]

    def bag():
        def model(texts_):
            out = np.zeros((len(texts_), 32))
            for i, text in enumerate(texts_):
                for t in text.split():
                    out[i, int(t[1:]) if t[1:].isdigit() else 31] += 1
            return out

        return model

    got = values(evaluate(data, "sentence_transformer", factory=bag))
    assert 0 < got["d", "ndcg_at_10"] < 1
    parsed = data.but(
        corpus=data.corpus.withColumn("doc_id", F.substring_index("chunk_id", "_", 1)).withColumn(
            "internal_id", F.substring_index("chunk_id", "_", -1).cast("int")
        )
    )
    in_context = values(
        evaluate(
            parsed,
            "contextual",
            factory=bag,
            contextual_factory=lambda: lambda documents: [bag()(d) for d in documents],
        )
    )
    assert in_context == got
    late = values(evaluate(data, "colbert", factory=HashedTokens(16)))
    same = values(evaluate(data, "colbert", factory=HashedTokens(16), form="grid"))
    assert late == same and 0 < late["d", "ndcg_at_10"]
    with pytest.raises(ValueError, match="unknown method"):
        evaluate(data, "guess")
    with pytest.raises(NotImplementedError):
        evaluate(data, "merged_contextual")


def test_prefix_reaches_the_encoder(spark, texts):
    data = texts[0]

    def firsts():
        return lambda texts_: [[float(t.startswith("search_document: ")), float(t.startswith("search_query: "))] for t in texts_]

    ready = plan.encoded(data, firsts, add_prefix=True)
    assert {tuple(r.vector) for r in ready.corpus.collect()} == {(1.0, 0.0)}
    assert {tuple(r.vector) for r in ready.queries.collect()} == {(0.0, 1.0)}


def test_length_suite_average(spark, sf):
    data = w.length_task(spark, sf)
    got = values(length_suite_metrics(data, method="bm25"))
    buckets = sorted({d for d, _ in got} - {"needle_avg"})
    mean = np.mean([got[b, "ndcg_at_10"] for b in buckets])
    assert got["needle_avg", "ndcg_at_10"] == pytest.approx(mean)
    none = values(length_suite_metrics(data, tasks=(), method="bm25"))
    assert {d for d, _ in none} == set(buckets)


def test_suite_equals_its_parts(spark, sf):
    one, two = w.conversations(spark, sf), w.answerable(w.passages(spark, sf))
    both = values(evaluate(one.union(two), "bm25", check=False))
    apart = [values(evaluate(x, "bm25", check=False)) for x in (one, two)]
    assert both == {**apart[0], **apart[1]}


def ten_sets(spark):
    sets = []
    for i in range(10):
        name = f"task_{i}" if i < 3 else f"s{i}"
        chunks = spark.createDataFrame([(name, f"{j}_0", "x" * (12 * i)) for j in range(3)], "dataset string, chunk_id string, text string")
        queries = spark.createDataFrame([(name, "q", 0, "ask")], "dataset string, query_id string, query_pos long, text string")
        labels = spark.createDataFrame([(name, "q", "1_0", 0)], "dataset string, query_id string, target_id string, label_pos int")
        sets.append(RetrievalSet(chunks, queries, labels))
    return merge(sets)


def test_runtime_is_told_for_each_data_set(spark):
    def slow_letters():
        """A plug-in that takes a millisecond for every letter x."""
        import time

        def model(texts):
            time.sleep(sum(t.count("x") for t in texts) / 1000)
            return [[float(len(t)), 1.0] for t in texts]

        return model

    found = values(length_suite_metrics(ten_sets(spark), tasks=("task",), method="sentence_transformer", factory=slow_letters, runtime=True))
    seconds = {d: v for (d, m), v in found.items() if m == "runtime"}
    assert len(seconds) == 11 and len(set(seconds.values())) == 11
    for i in range(10):
        own = seconds[f"task_{i}" if i < 3 else f"s{i}"]
        assert 0.036 * i <= own < 0.036 * i + 0.3
    assert seconds["task_avg"] == pytest.approx(np.mean([seconds[f"task_{i}"] for i in range(3)]))


def test_runtime_of_an_index_goes_by_tokens(spark, texts):
    counts = spark.createDataFrame([("a", None, 2, 30), ("b", None, 1, 10), ("a", "x", 1, 5)], "dataset string, term string, df long, total long")
    assert plan.shared_out(8.0, counts) == {"a": 6.0, "b": 2.0}
    scored = plan.lexical(texts[0])
    assert list(scored.runtime()) == ["d"] and scored.runtime()["d"] > 0


def test_limits_are_settled_with_the_factory(spark):
    from chunkrank.operators.encode import Limits, encode, first_words

    def knows_both(max_tokens=None, extended_context=False):
        return lambda texts: [[float(max_tokens or 0), float(extended_context), float(len(t))] for t in texts]

    def knows_none():
        return lambda texts: [[0.0, 0.0, float(len(t))] for t in texts]

    def takes_all(**limits):
        return lambda texts: [[float(limits["max_tokens"]), float(limits["extended_context"]), float(len(t))] for t in texts]

    rows_ = spark.createDataFrame([("d", "1", "one, two three"), ("d", "2", "--"), ("d", "3", "")], "dataset string, chunk_id string, text string")

    def sizes(factory, **limits):
        return [r.vector for r in encode(rows_.coalesce(1), factory, **limits).orderBy("chunk_id").collect()]

    assert sizes(knows_both, max_tokens=2) == [[2, 0, 14], [2, 0, 2], [2, 0, 0]]
    assert sizes(takes_all, max_tokens=2, extended_context=True) == [[2, 1, 14], [2, 1, 2], [2, 1, 0]]
    assert sizes(knows_none, max_tokens=2) == [[0, 0, 8], [0, 0, 2], [0, 0, 0]]
    assert sizes(knows_none, max_tokens=2, extended_context=True)[0] == [0, 0, 14]
    assert sizes(knows_none)[0] == [0, 0, 14]
    assert Limits(knows_none, 0).texts(["a b"]) == [""]
    assert first_words("été_ça 漢字", 2) == "été_ça" and first_words("a", 5) == "a"


@pytest.mark.parametrize("method", ["sentence_transformer", "contextual"])
def test_limits_reach_the_plug_in_from_evaluate(spark, method):
    data = text_set(spark, [("1", "a b c"), ("2", "c")], [("q", "a a a")], [("q", "1")])
    seen = lambda max_tokens=None, extended_context=False: lambda texts: [[float(max_tokens)] for _ in texts]
    every = lambda max_tokens=None: lambda docs: [[[float(max_tokens)] for _ in d] for d in docs]
    options = {"contextual_factory": every} if method == "contextual" else {}
    scored = plan.scored_by(data, method, factory=seen, max_tokens=7, **options)
    assert {tuple(r.vector) for r in scored.chunks.collect()} == {(7.0,)}
    assert {tuple(r.vector) for r in scored.queries.collect()} == {(7.0,)}


@pytest.mark.parametrize("width", [1, 3, 512])
def test_late_chunks_by_overlapping_spans(spark, width):
    from chunkrank.operators.encode import late_chunks

    rng = np.random.default_rng(width)
    tokens = [("d", f"doc{d}", i, rng.normal(size=2).round(3).tolist()) for d in range(3) for i in range(20 * d + 5)]
    spans = [("d", f"doc{d}", f"doc{d}_{n}", b, b + size) for d in range(4) for n, (b, size) in enumerate([(0, 3), (2, 9), (4, 1), (5, 0), (30, 100)])]
    t = spark.createDataFrame(tokens, "dataset string, doc_id string, offset int, vector array<float>")
    s = spark.createDataFrame(spans, "dataset string, doc_id string, chunk_id string, begin int, end int")
    got = {r.chunk_id: r.vector for r in late_chunks(t, s, width).collect()}
    want = {}
    for _, doc, chunk, begin, end in spans:
        inside = [v for _, d, i, v in tokens if d == doc and begin <= i < end]
        if inside:
            want[chunk] = np.mean(inside, axis=0)
    assert set(got) == set(want)
    assert all(np.allclose(got[c], want[c], atol=1e-5) for c in want)


def test_passages_of_any_length_are_found(spark, tmp_path, monkeypatch):
    texts_ = [(1, "one two three"), (2, "a one two three, four"), (3, "onetwo three"), (4, None), (5, "")]
    items = [(10, "one two three"), (11, "two"), (12, "e t"), (13, "one two three"), (14, "absent"), (15, None), (16, "")]
    spark.createDataFrame(texts_, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = sorted(
        (i, d, len(t[: t.index(p)].split())) for i, p in items for d, t in texts_ if p is not None and t is not None and p in t
    )
    assert rows(w.passage_labels(spark, str(tmp_path)), "item_id", "doc_id", "start_word") == want
    monkeypatch.setattr(w, "AUTOMATON_CHARACTERS", 5)
    assert rows(w.passage_labels(spark, str(tmp_path)), "item_id", "doc_id", "start_word") == want


def test_own_scorer(texts):
    """A callable takes the place of a named method."""
    data = texts[0]
    own = values(evaluate(data, lambda d: plan.lexical(d, k1=1.2), runtime=True))
    assert own.pop(("d", "runtime")) > 0
    assert own == values(evaluate(data, "bm25", k1=1.2))


def vector_set(spark, chunks, extra="chunk_pos int"):
    corpus = spark.createDataFrame(chunks, f"dataset string, chunk_id string, vector array<float>, {extra}")
    queries = spark.createDataFrame([("d", "q", 0, [1.0])], "dataset string, query_id string, query_pos long, vector array<float>")
    qrels = spark.createDataFrame([("d", "q", "a_1", 0)], "dataset string, query_id string, target_id string, label_pos int")
    return RetrievalSet(corpus, queries, qrels)


@pytest.mark.parametrize("parents", [True, False])
def test_the_last_chunk_of_an_id_counts(spark, parents):
    data = vector_set(spark, [("d", "a_1", [1.0], 0), ("d", "a_1", [0.05], 1), ("d", "b_1", [0.1], 2)])
    found = values(evaluate(data, "dense", max_sim_over_docs=parents))
    assert found["d", "recall_at_10"] == 1.0 and found["d", "ndcg_at_10"] == 0.63093


def test_repeated_ids_without_order_are_an_error(spark):
    data = vector_set(spark, [("d", "a_1", [1.0], 0), ("d", "a_1", [0.05], 1)])
    data = data.but(corpus=data.corpus.drop("chunk_pos"))
    with pytest.raises(ValueError, match="more than once"):
        evaluate(data, "dense")
    found = values(evaluate(data, "dense", check=False, max_sim_over_docs=False))
    assert max(v for (_, m), v in found.items() if "_at_" in m) <= 1.0


def test_scores_must_be_numbers(spark):
    data = vector_set(spark, [("d", "a_1", [1.0], 0), ("d", "b_1", [float("nan")], 1)])
    with pytest.raises(Exception, match="not a finite number"):
        evaluate(data, "dense").collect()


def test_contextual_needs_its_models_and_works_without_documents(spark):
    data = text_set(spark, [("1", "a b"), ("2", "c")], [("q", "a")], [("q", "1")])
    one = lambda: lambda texts: [[float(len(t))] for t in texts]
    with pytest.raises(ValueError, match="contextual_factory"):
        evaluate(data, "contextual", factory=one)
    with pytest.raises(ValueError, match="factory"):
        evaluate(data, "dense")
    every = lambda: lambda docs: [[[float(len(t))] for t in d] for d in docs]
    found = values(evaluate(data, "contextual", factory=one, contextual_factory=every))
    assert found["d", "recall_at_1"] == 1.0


def test_bm25_counts_a_supplied_empty_token_as_a_term(spark):
    from chunkrank.operators import bm25

    corpus = spark.createDataFrame(
        [("d", "1", ["x", ""]), ("d", "2", ["y"])], "dataset string, chunk_id string, tokens array<string>"
    )
    counts = bm25.term_counts(corpus)
    assert rows(bm25.corpus_size(counts), "chunks", "avgdl") == [(2, 1.5)]
    assert rows(bm25.term_weights(counts), "term", "df") == [("", 1), ("x", 1), ("y", 1)]


def test_late_interaction_with_one_long_chunk_under_small_blocks(spark, monkeypatch):
    from chunkrank.operators import scorers

    rng = np.random.default_rng(0)
    query, at = rng.normal(size=(70, 4)), np.array([0, 3, 40, 70])
    chunk, chunk_at = rng.normal(size=(8010, 4)), np.array([0, 5, 8005, 8010])
    scorer = scorers.MaxSim()
    whole = scorer.score((query, at), (chunk, chunk_at, None), 0, 3)
    monkeypatch.setattr(scorers, "BLOCK_CELLS", 200)
    monkeypatch.setattr(scorers, "QUERY_TOKENS", 8)
    assert np.allclose(scorer.score((query, at), (chunk, chunk_at, None), 0, 3), whole)
    cells = query @ chunk.T
    plain = [[cells[a:b, c:d].max(axis=1).sum() for c, d in zip(chunk_at, chunk_at[1:])] for a, b in zip(at, at[1:])]
    assert np.allclose(whole, plain)
