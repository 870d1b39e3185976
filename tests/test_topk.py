"""The physical forms and the floors against a plain all-pairs computation."""

import numpy as np
import pytest
from conftest import rows

import chunkrank.operators.scorers as scorers
import chunkrank.operators.topk as topk
from chunkrank.operators import tiles
from chunkrank.operators.scorers import Bm25, Dense, MaxSim
from chunkrank.operators.topk import best_targets, rank_targets
from chunkrank.session import scan_tasks


def brute(scores, query_ids, chunk_ids, k, parents=False, ignore=True):
    """Sorted (query, target, score) of the best k."""
    out = []
    for i, q in enumerate(query_ids):
        best = {}
        for j, c in enumerate(chunk_ids):
            if ignore and q == c:
                continue
            target = c.split("_")[0] if parents else c
            if parents and ignore and target == q:
                continue
            value = round(float(scores[i, j]), 6) + 0.0
            best[target] = max(best.get(target, -np.inf), value)
        ordered = sorted(sorted(best, reverse=True), key=lambda t: -best[t])[:k]
        out += [(q, t, best[t], r + 1) for r, t in enumerate(ordered)]
    return sorted(out)


def levels(ranked):
    got = {}
    for r in ranked.collect():
        got.setdefault(r.level, []).append((r.query_id, r.target_id, r.score, r.rank))
    return {name: sorted(values) for name, values in got.items()}


@pytest.fixture(scope="module")
def dense_case(spark):
    rng = np.random.default_rng(3)
    # Few distinct values, so that ties at the cut are common.
    queries = rng.integers(-1, 2, (23, 6)).astype(float)
    chunks = rng.integers(-1, 2, (311, 6)).astype(float)
    query_ids = [f"{i}" if i % 3 else f"{i}_0" for i in range(len(queries))]
    chunk_ids = [f"{i // 4}_{i % 4}" if i % 5 else f"{i}" for i in range(len(chunks))]
    chunk_ids = list(dict.fromkeys(chunk_ids))
    chunks = chunks[: len(chunk_ids)]
    q = spark.createDataFrame(
        [("d", i, v.tolist()) for i, v in zip(query_ids, queries)],
        "dataset string, query_id string, vector array<float>",
    )
    c = spark.createDataFrame(
        [("d", i, v.tolist()) for i, v in zip(chunk_ids, chunks)],
        "dataset string, chunk_id string, vector array<float>",
    )
    return q, c, queries @ chunks.T, query_ids, chunk_ids


@pytest.mark.parametrize("parts", [1, 2, 7])
@pytest.mark.parametrize("k", [1, 10, 100])
def test_dense_broadcast_form(dense_case, parts, k):
    q, c, scores, query_ids, chunk_ids = dense_case
    got = levels(rank_targets(best_targets(q, c.repartition(parts), Dense(), k=k, parent_k=5), k=k, parent_k=5))
    assert got["chunk"] == brute(scores, query_ids, chunk_ids, k)
    assert got["parent"] == brute(scores, query_ids, chunk_ids, 5, parents=True)


@pytest.mark.parametrize("cells", [(100, 1000), (5, 40), (1, 7)])
def test_dense_grid_form(dense_case, cells):
    q, c, scores, query_ids, chunk_ids = dense_case
    found = best_targets(
        q, c, Dense(), k=10, parent_k=5, form="grid", query_cell=cells[0], chunk_cell=cells[1]
    )
    got = levels(rank_targets(found, k=10, parent_k=5))
    assert got["chunk"] == brute(scores, query_ids, chunk_ids, 10)
    assert got["parent"] == brute(scores, query_ids, chunk_ids, 5, parents=True)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_too_many_queries_turn_to_tiles(dense_case, monkeypatch):
    q, c, scores, query_ids, chunk_ids = dense_case
    monkeypatch.setattr(topk, "BROADCAST_QUERIES", 10)
    found = best_targets(q, c, Dense(), k=10)
    assert "FlatMapCoGroups" not in plan_of(found) and "Exchange" not in plan_of(found)
    assert levels(rank_targets(found, k=10))["chunk"] == brute(scores, query_ids, chunk_ids, 10)


@pytest.mark.parametrize("cells", [(100, 1000), (5, 40), (1, 7)])
@pytest.mark.parametrize("with_floors", [False, True])
def test_dense_tile_form(dense_case, cells, with_floors):
    q, c, scores, query_ids, chunk_ids = dense_case
    found = best_targets(
        q, c.repartition(5), Dense(), k=10, parent_k=5, form="tiles", query_cell=cells[0], chunk_cell=cells[1],
        with_floors=with_floors, floor_every=2,
    )
    got = levels(rank_targets(found, k=10, parent_k=5))
    assert got["chunk"] == brute(scores, query_ids, chunk_ids, 10)
    assert got["parent"] == brute(scores, query_ids, chunk_ids, 5, parents=True)


def test_tiles_hold_their_bounds(dense_case):
    q = dense_case[0]
    stored = tiles.written(q, ["dataset"], Dense().query_elements(), rows=8_192, most_elements=30)
    sizes = [tiles.load(f, ["query_id", "vector"]).num_rows for f in stored.files]
    assert sum(sizes) == q.count() and max(sizes) <= 5
    assert stored.readable()
    assert not tiles.Tiles(("nowhere://x/y.parquet",), stored.table).readable()


def test_a_folder_that_tasks_cannot_open_turns_to_the_grid(dense_case, monkeypatch):
    q, c, scores, query_ids, chunk_ids = dense_case
    monkeypatch.setattr(tiles.Tiles, "readable", lambda self: False)
    found = best_targets(q, c, Dense(), k=10, form="tiles")
    assert "FlatMapCoGroups" in plan_of(found)
    assert levels(rank_targets(found, k=10))["chunk"] == brute(scores, query_ids, chunk_ids, 10)


def test_ten_thousand_queries_move_no_chunk(spark):
    rng = np.random.default_rng(8)
    queries, chunks = rng.normal(size=(10_000, 3)).round(2), rng.normal(size=(300, 3)).round(2)
    q = spark.createDataFrame(
        [("d", f"q{i}", v.tolist()) for i, v in enumerate(queries)], "dataset string, query_id string, vector array<double>"
    )
    c = spark.createDataFrame(
        [("d", f"{i}_0", v.tolist()) for i, v in enumerate(chunks)], "dataset string, chunk_id string, vector array<double>"
    )
    found = best_targets(q, c, Dense(), k=3)
    assert "Exchange" not in plan_of(found) and "CoGroups" not in plan_of(found)
    same = best_targets(q, c, Dense(), k=3, form="broadcast")
    names = ("query_id", "target_id", "score", "rank")
    assert rows(rank_targets(found, k=3), *names) == rows(rank_targets(same, k=3), *names)


@pytest.mark.parametrize("form", ["broadcast", "tiles"])
def test_floors_send_fewer_candidates_and_change_nothing(spark, form):
    rng = np.random.default_rng(12)
    queries, chunks = rng.normal(size=(20, 4)).round(1), rng.normal(size=(4000, 4)).round(1)
    qi, ci = [f"q{i}" for i in range(20)], [f"{i // 3}_{i % 3}" for i in range(4000)]
    q = spark.createDataFrame([("d", i, v.tolist()) for i, v in zip(qi, queries)], "dataset string, query_id string, vector array<double>")
    c = spark.createDataFrame([("d", i, v.tolist()) for i, v in zip(ci, chunks)], "dataset string, chunk_id string, vector array<double>")
    c = c.repartition(40)
    plain = best_targets(q, c, Dense(), k=10, parent_k=5, form=form, with_floors=False)
    floored = best_targets(q, c, Dense(), k=10, parent_k=5, form=form, with_floors=True, floor_every=4)
    assert plain.count() == 40 * 20 * (10 + 5)
    assert floored.count() < 0.3 * plain.count()
    got = levels(rank_targets(floored, k=10, parent_k=5))
    assert got["chunk"] == brute(queries @ chunks.T, qi, ci, 10)
    assert got["parent"] == brute(queries @ chunks.T, qi, ci, 5, parents=True)
    assert got == levels(rank_targets(plain, k=10, parent_k=5, levels=2))


def test_floors_of_queries_that_the_sample_cannot_fill(dense_case):
    q, c, scores, query_ids, chunk_ids = dense_case
    found = best_targets(q, c.repartition(6), Dense(), k=200, with_floors=True, floor_every=6)
    assert levels(rank_targets(found, k=200))["chunk"] == brute(scores, query_ids, chunk_ids, 200)


def test_tasks_of_a_scan_are_estimated_from_its_files(spark, tmp_path):
    spark.range(200_000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
        assert scan_tasks(table.filter("id > 5")) > 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert scan_tasks(table) == 1
    assert scan_tasks(spark.createDataFrame([(1,)], "a int")) == 1


def test_small_pieces_and_shrinking(dense_case, monkeypatch):
    monkeypatch.setattr(topk, "FEWEST_ROWS", 8)
    monkeypatch.setattr(topk, "BLOCK_CELLS", 64)
    q, c, scores, query_ids, chunk_ids = dense_case
    plan = topk._Plan(Dense(), ["dataset"], [c.schema["dataset"]], 3, 2, True)
    task = topk._Task(plan, ("d",), q.toArrow())
    task.feed(c.toArrow())
    assert task.levels[0].rows < 60 * len(query_ids)
    got = {}
    for batch in task.results():
        for r in batch.to_pylist():
            got.setdefault(r["level"], []).append((r["query_id"], r["target_id"], r["score"]))
    assert sorted(got["chunk"]) == [b[:3] for b in brute(scores, query_ids, chunk_ids, 3)]
    assert sorted(got["parent"]) == [b[:3] for b in brute(scores, query_ids, chunk_ids, 2, parents=True)]


def test_identical_ids_can_stay(dense_case):
    q, c, scores, query_ids, chunk_ids = dense_case
    found = best_targets(q, c, Dense(), k=10, parent_k=5, ignore_identical_ids=False)
    got = levels(rank_targets(found, k=10, parent_k=5))
    assert got["chunk"] == brute(scores, query_ids, chunk_ids, 10, ignore=False)
    assert got["parent"] == brute(scores, query_ids, chunk_ids, 5, parents=True, ignore=False)


def test_one_hot_parent_is_split_over_cells(spark):
    rng = np.random.default_rng(5)
    chunks = rng.normal(size=(400, 4))
    chunk_ids = [f"hot_{i}" if i < 300 else f"p{i}_0" for i in range(400)]
    queries = rng.normal(size=(9, 4))
    query_ids = [f"q{i}" for i in range(9)]
    q = spark.createDataFrame(
        [("d", i, v.tolist()) for i, v in zip(query_ids, queries)],
        "dataset string, query_id string, vector array<double>",
    )
    c = spark.createDataFrame(
        [("d", i, v.tolist()) for i, v in zip(chunk_ids, chunks)],
        "dataset string, chunk_id string, vector array<double>",
    )
    found = best_targets(q, c, Dense(), k=5, parent_k=5, form="grid", query_cell=4, chunk_cell=50)
    got = levels(rank_targets(found, k=5, parent_k=5))
    assert got["parent"] == brute(queries @ chunks.T, query_ids, chunk_ids, 5, parents=True)


@pytest.mark.parametrize("form", ["auto", "grid", "tiles"])
def test_keys_keep_groups_apart(spark, form):
    rng = np.random.default_rng(11)
    q_rows, c_rows, expected = [], [], []
    for name, trial in [("a", 0), ("a", 1), ("b", 0)]:
        queries, chunks = rng.normal(size=(4, 3)), rng.normal(size=(30, 3))
        qi, ci = [f"q{i}" for i in range(4)], [f"{i}_0" for i in range(30)]
        q_rows += [(name, trial, i, v.tolist()) for i, v in zip(qi, queries)]
        c_rows += [(name, trial, i, v.tolist()) for i, v in zip(ci, chunks)]
        expected += [(name, trial, *row) for row in brute(queries @ chunks.T, qi, ci, 3)]
    c_rows.append(("nobody asks", 0, "1_1", [1.0, 0.0, 0.0]))
    keys = ("dataset", "trial")
    q = spark.createDataFrame(q_rows, "dataset string, trial int, query_id string, vector array<double>")
    c = spark.createDataFrame(c_rows, "dataset string, trial int, chunk_id string, vector array<double>")
    ranked = rank_targets(best_targets(q, c, Dense(), keys, k=3, form=form), keys, 3)
    assert rows(ranked, "dataset", "trial", "query_id", "target_id", "score", "rank") == sorted(expected)


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


@pytest.mark.parametrize("pad_floor", [False, True])
@pytest.mark.parametrize("form", ["auto", "grid", "tiles"])
def test_maxsim(spark, pad_floor, form, monkeypatch):
    # shipped to the workers by value, so they score in the same tiny blocks
    monkeypatch.setattr(scorers, "BLOCK_CELLS", 150)
    rng = np.random.default_rng(2)
    queries = [rng.normal(size=(rng.integers(1, 6), 5)) for _ in range(8)]
    chunks = [rng.normal(size=(rng.integers(1, 9), 5)) for _ in range(60)]
    chunks[7][0] = 0.0
    longest = max(len(c) for c in chunks)
    scores = np.zeros((8, 60))
    for i, q in enumerate(queries):
        for j, c in enumerate(chunks):
            best = (unit(q) @ unit(c).T).max(axis=1)
            if pad_floor and len(c) < longest:
                best = np.maximum(best, 0)
            scores[i, j] = best.sum()
    qi, ci = [f"q{i}" for i in range(8)], [f"{j}_1" for j in range(60)]
    q = spark.createDataFrame(
        [("d", i, m.tolist()) for i, m in zip(qi, queries)],
        "dataset string, query_id string, token_vectors array<array<double>>",
    )
    c = spark.createDataFrame(
        [("d", i, m.tolist(), len(m) < longest) for i, m in zip(ci, chunks)],
        "dataset string, chunk_id string, token_vectors array<array<double>>, padded boolean",
    )
    found = best_targets(q, c, MaxSim(pad_floor), k=10, form=form, query_cell=3, chunk_cell=20)
    assert levels(rank_targets(found, k=10))["chunk"] == brute(scores, qi, ci, 10)


def test_mixed_vector_lengths_fail(spark):
    q = spark.createDataFrame([("d", "q", [1.0, 2.0])], "dataset string, query_id string, vector array<double>")
    c = spark.createDataFrame(
        [("d", "a", [1.0, 2.0]), ("d", "b", [1.0])], "dataset string, chunk_id string, vector array<double>"
    ).coalesce(1)
    with pytest.raises(Exception, match="length"):
        best_targets(q, c, Dense()).collect()


def test_unknown_form(dense_case):
    with pytest.raises(ValueError, match="unknown form"):
        best_targets(dense_case[0], dense_case[1], Dense(), form="loop")


def test_bm25_kernel_with_common_terms():
    """Terms shared by most queries take the matrix path; the sums must not differ."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [list(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(50)]
    asked = [sorted({*rng.choice(vocabulary, 5), "w0", "w1"}) for _ in range(60)]
    weights = [list(rng.normal(size=len(a))) for a in asked]
    avgdl = float(np.mean([len(d) for d in docs]))
    scorer = Bm25()
    loaded = scorer.load(
        pa.table({"query_id": [str(i) for i in range(60)], "terms": asked, "weights": weights, "avgdl": [avgdl] * 60})
    )
    assert loaded["common"].any() and not loaded["common"].all()
    chunks = scorer.prepare(loaded, pa.table({"tokens": pa.array(docs, pa.list_(pa.string()))}))
    got = np.hstack([scorer.score(loaded, chunks, i, min(i + 7, 50)) for i in range(0, 50, 7)])
    for i, terms in enumerate(asked):
        for j, doc in enumerate(docs):
            want = 0.0
            for term, weight in zip(terms, weights[i]):
                tf = doc.count(term)
                want += weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(doc) / avgdl)) if tf else 0
            assert got[i, j] == pytest.approx(want)
