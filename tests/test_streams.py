"""Tasks that all chunks pass: few rows leave, pieces are bounded, floors are right across batches."""

import numpy as np
import pyarrow as pa
from conftest import rows
from pyspark.sql import types as T

import chunkrank.operators.scorers as scorers
import chunkrank.operators.topk as topk
from chunkrank.functions.text import tokens
from chunkrank.operators import bm25, tiles
from chunkrank.operators.scorers import Bm25, Dense
from chunkrank.operators.topk import best_targets, rank_targets

NAMES = ("level", "query_id", "target_id", "score", "rank")


def task_of(queries, k, parent_k, scorer=None):
    fields = [T.StructField("dataset", T.StringType())]
    return topk._Task(topk._Plan(scorer or Dense(), ["dataset"], fields, k, parent_k, True), ("d",), queries)


def vectors(spark, name, values):
    data = [("d", i, v.tolist()) for i, v in values]
    return spark.createDataFrame(data, f"dataset string, {name} string, vector array<double>")


def test_many_queries_send_k_rows_each_however_the_chunks_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(topk, "BROADCAST_QUERIES", 10)
    rng = np.random.default_rng(4)
    q = vectors(spark, "query_id", [(f"q{i}", v) for i, v in enumerate(rng.normal(size=(30, 4)).round(1))])
    c = vectors(spark, "chunk_id", [(f"{i // 3}_{i % 3}", v) for i, v in enumerate(rng.normal(size=(900, 4)).round(1))])
    found = best_targets(q, c.repartition(20), Dense(), k=7, parent_k=4)
    assert found.count() == 30 * (7 + 4)
    same = best_targets(q, c, Dense(), k=7, parent_k=4, form="broadcast")
    assert rows(rank_targets(found, k=7, parent_k=4), *NAMES) == rows(rank_targets(same, k=7, parent_k=4), *NAMES)


def test_a_parent_found_in_many_batches_is_one_parent():
    queries = pa.table({"query_id": ["q"], "vector": [[1.0]]})
    task = task_of(queries, 0, 3)
    for score in (9.0, 8.0, 7.0, 6.0, 5.0):
        task.feed(pa.table({"chunk_id": [f"a_{int(score)}"], "vector": [[score]]}))
    task.feed(pa.table({"chunk_id": ["b_0", "c_0", "d_0"], "vector": [[2.0], [1.0], [0.5]]}))
    found = [(r["target_id"], r["score"]) for b in task.results() for r in b.to_pylist()]
    assert sorted(found) == [("a", 9.0), ("b", 2.0), ("c", 1.0)]


def test_chunks_are_made_ready_in_pieces(monkeypatch):
    monkeypatch.setattr(topk, "PIECE_BYTES", 4_000, raising=False)
    sizes = []

    class Watched(Dense):
        def prepare(self, queries, batch):
            sizes.append(batch.num_rows)
            return super().prepare(queries, batch)

    queries = pa.table({"query_id": ["q"], "vector": [[1.0, 0.0]]})
    task = task_of(queries, 2, 0, Watched())
    n = 2_000
    task.feed(pa.table({"chunk_id": [f"c{i}" for i in range(n)], "vector": [[float(i), 1.0] for i in range(n)]}))
    assert sum(sizes) == n and max(sizes) < 400
    found = [(r["target_id"], r["score"]) for b in task.results() for r in b.to_pylist()]
    assert sorted(found) == [("c1998", 1998.0), ("c1999", 1999.0)]


def test_equal_scores_keep_the_larger_ids_over_many_batches():
    queries = pa.table({"query_id": ["q", "r"], "vector": [[0.0], [1.0]]})
    task = task_of(queries, 2, 0)
    for i in np.random.default_rng(1).permutation(60):
        task.feed(pa.table({"chunk_id": [f"c{i:02}"], "vector": [[float(i % 7)]]}))
    assert task.levels[0].rows <= 4 * 2 * 2 + 2
    found = {(r["query_id"], r["target_id"]) for b in task.results() for r in b.to_pylist()}
    assert found == {("q", "c59"), ("q", "c58"), ("r", "c55"), ("r", "c48")}


def test_bm25_scores_stored_terms_as_it_does_texts(spark):
    texts = ["a b a", "b", "", None, "c c c a d", "A, b; z"]
    rows_ = [("d", f"{i}_0", t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows_, "dataset string, chunk_id string, text string").withColumn("tokens", tokens("text"))
    queries = chunks.select("dataset", chunks.chunk_id.alias("query_id"), "tokens").filter("query_id < '5'")
    weighted = bm25.weighted_queries(queries, bm25.term_counts(chunks))
    whole = best_targets(weighted, chunks, Bm25(), k=4, ignore_identical_ids=False, form="broadcast")
    stored = best_targets(weighted, chunks, Bm25(), k=4, ignore_identical_ids=False, form="tiles")
    assert rows(rank_targets(stored, k=4), *NAMES) == rows(rank_targets(whole, k=4), *NAMES)
    assert stored.count() == 5 * 4


def test_row_groups_of_other_data_sets_are_not_read(tmp_path):
    import pyarrow.parquet as pq

    names = ["a"] * 3 + ["b"] * 3 + [None] * 3
    pq.write_table(pa.table({"dataset": names, "chunk_id": [str(i) for i in range(9)]}), tmp_path / "t.parquet", row_group_size=3)
    def read(wanted):
        return [i for t in tiles.batches(f"file:{tmp_path}/t.parquet", ["dataset", "chunk_id"], 2, 1, wanted) for i in t["chunk_id"].to_pylist()]

    assert read(None) == [str(i) for i in range(9)]
    assert read({"b"}) == ["3", "4", "5", "6", "7", "8"]  # a group of nulls alone has no least value
    assert read({"A"}) == ["6", "7", "8"]


def test_chunks_that_come_twice_take_one_rank(spark):
    rng = np.random.default_rng(6)
    values = [(f"{i // 2}_{i % 2}", v) for i, v in enumerate(rng.normal(size=(60, 3)).round(1))]
    q = vectors(spark, "query_id", [(f"q{i}", v) for i, v in enumerate(rng.normal(size=(9, 3)))])
    twice = vectors(spark, "chunk_id", values + values[::-1])
    found = rank_targets(best_targets(q, twice, Dense(), k=20, form="tiles"), k=20)
    once = rank_targets(best_targets(q, vectors(spark, "chunk_id", values), Dense(), k=20, form="broadcast"), k=20)
    assert rows(found, *NAMES) == rows(once, *NAMES)


def test_a_task_takes_a_bounded_share_of_the_chunks(spark, monkeypatch):
    """However many chunks there are; with few tiles the cores decide as before."""
    assert topk.stream_shares(1_000, 500, 12_000_001, 48) == 4
    assert topk.stream_shares(10, 500, 12_000_001, 48) == 5
    assert topk.stream_shares(1, 3, 1_000, 48) == 1
    monkeypatch.setattr(topk, "MOST_ROWS", 100)
    rng = np.random.default_rng(4)
    q = vectors(spark, "query_id", [(f"q{i}", v) for i, v in enumerate(rng.normal(size=(30, 4)).round(1))])
    c = vectors(spark, "chunk_id", [(f"{i // 3}_{i % 3}", v) for i, v in enumerate(rng.normal(size=(600, 4)).round(1))])
    found, most = topk.candidates(q, c.repartition(6), Dense(), k=7, form="tiles")
    assert found.count() == most == 30 * 7 * 6
    same = best_targets(q, c, Dense(), k=7, form="broadcast")
    assert rows(rank_targets(found, k=7), *NAMES) == rows(rank_targets(same, k=7), *NAMES)


def test_many_candidates_are_ranked_by_more_tasks(spark, monkeypatch):
    """Rows that compress well would be put into one task by their bytes."""
    rng = np.random.default_rng(5)
    q = vectors(spark, "query_id", [(f"q{i}", v) for i, v in enumerate(rng.normal(size=(40, 3)).round(1))])
    c = vectors(spark, "chunk_id", [(f"{i}_0", v) for i, v in enumerate(rng.normal(size=(200, 3)).round(1))])
    found, most = topk.candidates(q, c, Dense(), k=50, form="tiles")
    assert most >= 40 * 50
    once = rank_targets(found, k=50)
    assert once.rdd.getNumPartitions() < 10
    monkeypatch.setattr(topk, "RANK_ROWS", most // 20)
    dealt = rank_targets(found, k=50, rows=most)
    assert dealt.rdd.getNumPartitions() == 20
    assert rows(dealt, *NAMES) == rows(once, *NAMES)


def test_a_first_block_is_cut_before_it_is_sorted(monkeypatch):
    """Only scores that reach the k-th of the block, ties included, are taken up."""
    taken = []
    take = topk._Best._take
    monkeypatch.setattr(topk._Best, "_take", lambda self, query, *rest: (taken.append(len(query)), take(self, query, *rest)))
    n = 900
    task = task_of(pa.table({"query_id": ["q", "r"], "vector": [[1.0], [-1.0]]}), 4, 0)
    task.feed(pa.table({"chunk_id": [f"c{i:03}" for i in range(n)], "vector": [[float(i // 3)] for i in range(n)]}))
    assert taken == [12]
    assert (task.levels[0].least == np.array([298.0, -1.0]) * topk.SCORE_STEPS).all()
    found = {(r["query_id"], r["target_id"]) for b in task.results() for r in b.to_pylist()}
    assert found == {("q", f"c{i}") for i in (899, 898, 897, 896)} | {("r", f"c{i:03}") for i in (2, 1, 0, 5)}


def test_bm25_makes_nothing_of_terms_that_no_query_asks_for(monkeypatch):
    queries = pa.table({"query_id": ["q"], "terms": [["b", "z"]], "weights": [[2.0, 1.0]], "avgdl": [2.0]})
    scorer = Bm25()
    loaded = scorer.load(queries)
    monkeypatch.setattr(scorers, "counted", None)
    lists = pa.array([["a", "b", "b", None], [], None, ["x"], ["z", "b"]], pa.list_(pa.string()))
    doc, code, gain = scorer.prepare(loaded, pa.table({"tokens": lists}))
    assert doc.tolist() == [0, 4, 4]
    assert loaded["vocabulary"].take(pa.array(code)).to_pylist() in (["b", "b", "z"], ["b", "z", "b"])
    norm = 1.5 * (0.25 + 0.75 * np.array([4, 2, 2]) / 2.0)
    tf = np.array([2, 1, 1])
    assert np.allclose(gain, tf * 2.5 / (tf + norm))


def test_a_task_holds_no_more_queries_than_a_tile(spark):
    """Queries that are sent to every task leave k rows from each; more than a tile of them are not sent."""
    n = topk.STREAM_QUERIES[1] + 60
    rng = np.random.default_rng(7)
    q = vectors(spark, "query_id", [(f"q{i}", v) for i, v in enumerate(rng.normal(size=(n, 2)))])
    c = vectors(spark, "chunk_id", [(f"{i}_0", v) for i, v in enumerate(rng.normal(size=(40, 2)))])
    found = best_targets(q, c.repartition(4), Dense(), k=2)
    assert found.count() == n * 2


def bm25_sides(rng, n_queries, n_chunks):
    words = np.array([f"w{i}" for i in range(300)])
    share = 1 / np.arange(1, 301)

    def texts(n):
        return [sorted(rng.choice(words, size=rng.integers(3, 30), p=share / share.sum()).tolist()) for _ in range(n)]

    asked = [sorted(set(t)) for t in texts(n_queries)]
    queries = pa.table(
        {
            "query_id": [f"q{i}" for i in range(n_queries - 1)] + ["7_1"],
            "terms": pa.array(asked, pa.list_(pa.string())),
            "weights": [[float(w) for w in rng.uniform(0.5, 6, len(t))] for t in asked],
            "avgdl": [16.0] * n_queries,
        }
    )
    chunks = pa.table({"chunk_id": [f"{i // 3}_{i % 3}" for i in range(n_chunks)], "tokens": pa.array(texts(n_chunks), pa.list_(pa.string()))})
    return queries, chunks


def test_most_blocks_are_scored_in_full_only_where_it_matters(monkeypatch):
    """Once the floors have risen a block is scored in float32 and few of its cells again; the rows are those of all scores."""
    monkeypatch.setattr(topk, "BLOCK_CELLS", 40 * 128)
    rng = np.random.default_rng(8)
    queries, chunks = bm25_sides(rng, 40, 9_000)
    full, settled = [], []
    score, settle = Bm25.score, Bm25.settled
    monkeypatch.setattr(Bm25, "score", lambda *a: (full.append(a[4] - a[3]), score(*a))[1])
    monkeypatch.setattr(Bm25, "settled", lambda *a: (settled.append(len(a[4])), settle(*a))[1])

    def best(k, parent_k, distinct):
        schema = [T.StructField("dataset", T.StringType())]
        task = topk._Task(topk._Plan(Bm25(), ["dataset"], schema, k, parent_k, True), ("d",), queries, distinct)
        task.feed(chunks)
        # Rows besides those of the best ranks may differ: which are cut when is no promise.
        rows = sorted((r for b in task.results() for r in b.to_pylist()), key=lambda r: (r["query_id"], r["level"], r["score"], r["target_id"]), reverse=True)
        depth, kept = {}, []
        for r in rows:
            at = depth[r["query_id"], r["level"]] = depth.get((r["query_id"], r["level"]), 0) + 1
            if at <= (k if r["level"] == topk.CHUNK else parent_k):
                kept.append((r["query_id"], r["level"], r["target_id"], round(r["score"], 6)))
        return kept

    for k, parent_k, distinct in ((6, 0, True), (0, 4, False), (6, 4, False)):
        full.clear(), settled.clear()
        found = best(k, parent_k, distinct)
        assert sum(full) < 9_000 / 2 and 0 < sum(settled) < 40 * 9_000 / 16
        with monkeypatch.context() as plain:
            plain.setattr(Bm25, "rough", lambda *a: None)
            assert found == best(k, parent_k, distinct)
        assert any(q == "7_1" for q, *_ in found) and not any(q == target for q, _, target, _ in found)


def test_rough_scores_are_off_by_no_more_than_they_say():
    rng = np.random.default_rng(9)
    queries, chunks = bm25_sides(rng, 30, 500)
    scorer = Bm25()
    loaded = scorer.load(queries)
    packed = scorer.prepare(loaded, chunks)
    scores = scorer.score(loaded, packed, 100, 500)
    rough = scorer.rough(loaded, packed, 100, 500)
    assert rough.scores.dtype == np.float32
    assert (np.abs(rough.scores - scores) <= rough.slack[:, None]).all() and rough.slack.max() < 0.02
    wanted = scores > np.quantile(scores, 0.9)
    assert np.allclose(scorer.settled(loaded, rough, wanted, np.flatnonzero(wanted)), scores[wanted], rtol=1e-13)


def test_terms_are_counted_a_batch_at_a_time(spark, monkeypatch):
    """Few rows leave a task however many chunks hold a term; nulls and supplied empty tokens as ever."""
    rows_ = [("x", ["a", "b", "a", None, ""]), ("y", []), ("x", None), (None, ["a"]), ("y", ["a"]), ("x", [None])]
    corpus = spark.createDataFrame(rows_ * 50, "dataset string, tokens array<string>").coalesce(1)
    taken = []
    monkeypatch.setattr(bm25, "materialised", lambda table: (taken.append(table), table)[1])
    found = {(r.dataset, r.term): (r.df, r.total) for r in bm25.term_counts(corpus).collect()}
    assert found == {
        ("x", "a"): (50, 250), ("x", "b"): (50, 250), ("x", ""): (50, 250), ("x", None): (100, 300),
        ("y", "a"): (50, 50), ("y", None): (100, 50), (None, "a"): (50, 50), (None, None): (50, 50),
    }
    plan = taken[0]._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    monkeypatch.setattr(bm25, "COUNT_BYTES", 1)
    assert {(r.dataset, r.term): (r.df, r.total) for r in bm25.term_counts(corpus).collect()} == found


def test_tiles_leave_no_small_rest_of_a_range(spark):
    """Ranges are drawn from a sample; one that is a little larger than the others stays one file."""
    rng = np.random.default_rng(10)
    q = vectors(spark, "query_id", [(f"q{i}", v) for i, v in enumerate(rng.normal(size=(20_000, 1)))])
    stored = tiles.written(q, ["dataset"], Dense().query_elements(), 4_096, 1 << 30, 16, 1_024)
    sizes = [tiles.load(f, ["query_id"]).num_rows for f in stored.files]
    assert len(sizes) == 16 and sum(sizes) == 20_000 and min(sizes) > 500 and max(sizes) <= 4_096
