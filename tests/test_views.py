"""Views, checks, statistics and encoders."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from chunkrank.functions.text import draw
from chunkrank.functions.vectors import l2_normalised
from chunkrank.operators import checks, encode, stats, views
from chunkrank.schema import RetrievalSet

CORPUS = "dataset string, doc_id string, internal_id int, chunk_id string, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    data = [
        ("d", "10", 1, "10_1", "b b b"),
        ("d", "10", 0, "10_0", "a"),
        ("d", "2", 0, "2_0", "c c c c"),
    ]
    return spark.createDataFrame(data, CORPUS)


def test_nested_lists_follow_positions(corpus):
    nested = views.nested(corpus)
    assert rows(nested, "doc_id", "chunk_ids", "texts") == [
        ("10", ["10_0", "10_1"], ["a", "b b b"]),
        ("2", ["2_0"], ["c c c c"]),
    ]
    flat = views.flatten(nested, "texts", "chunk_ids", "text", "chunk_id")
    assert rows(flat, "chunk_id", "text") == rows(corpus, "chunk_id", "text")


def test_long_documents_stay_whole(spark):
    long = spark.range(3000).select(
        F.lit("d").alias("dataset"),
        F.lit("hot").alias("doc_id"),
        F.col("id").cast("int").alias("internal_id"),
        F.concat(F.lit("hot_"), F.col("id").cast("string")).alias("chunk_id"),
        F.col("id").cast("string").alias("text"),
    )
    assert rows(views.nested(long), "texts") == [([str(i) for i in range(3000)],)]
    seen = encode.encode_in_context(long, lambda: lambda docs: [[[len(d)] for _ in d] for d in docs])
    assert rows(seen, "vector") == [([3000.0],)] * 3000


def test_context_in_order_by_batches_and_without_documents(spark):
    chunks = spark.range(40).select(
        F.lit("d").alias("dataset"),
        F.floor(F.col("id") / 2).cast("string").alias("doc_id"),
        (1 - F.col("id") % 2).cast("int").alias("internal_id"),
        F.col("id").cast("string").alias("chunk_id"),
        F.col("id").cast("string").alias("text"),
    )

    def factory():
        return lambda docs: [[[len(docs), int(d[0].removeprefix("p: ")), i] for i, _ in enumerate(d)] for d in docs]

    whole = {r.chunk_id: r.vector for r in encode.encode_in_context(chunks, factory, prompt="p: ", batch_size=3).collect()}
    assert all(v[0] <= 3 and v[1] == int(n) // 2 * 2 + 1 and v[2] == 1 - int(n) % 2 for n, v in whole.items())
    alone = encode.encode_in_context(chunks.drop("doc_id", "internal_id"), factory).collect()
    assert all(r.vector[1] == int(r.chunk_id) and r.vector[2] == 0 for r in alone)


def test_singletons_and_prompts(corpus):
    assert rows(views.singletons(corpus), "doc_id", "texts", "chunk_ids")[0] == ("10_0", ["a"], ["10_0"])
    assert rows(views.flat_documents(corpus, "d: "), "chunk_id", "text")[0] == ("10_0", "d: a")
    assert rows(views.flat_documents(corpus), "chunk_id", "text")[0] == ("10_0", "a")


def test_swap_is_stable_and_proportional(spark):
    many = spark.range(4000).select(
        F.concat(F.col("id").cast("string"), F.lit("_0")).alias("chunk_id"),
        F.lit("new").alias("text"),
        F.lit("old").alias("og_text"),
    )
    one, seven = (rows(views.swap_chunks(many.repartition(n), 0.3)) for n in (1, 7))
    assert one == seven
    share = sum(r[1] == "old" for r in one) / len(one)
    assert 0.26 < share < 0.34
    assert rows(views.swap_chunks(many, 0.0)) == rows(many)
    assert {r[1] for r in rows(views.swap_chunks(many, 1.0))} == {"old"}
    assert rows(many.select(draw(1, F.lit("2")).alias("u")).limit(1)) == [(3740562595 / 2**32,)]


def test_label_lists_keep_order_and_duplicates(spark):
    qrels = spark.createDataFrame(
        [("d", "q", "b", 0), ("d", "q", "a", 1), ("d", "q", "b", 2)],
        "dataset string, query_id string, target_id string, label_pos int",
    )
    assert rows(views.collected_labels(qrels), "target_ids") == [(["b", "a", "b"],)]


def test_cut_by_words(spark):
    documents = spark.createDataFrame([(1, "a b  c\nd e"), (2, "  ")], "doc_id long, text string")
    cut = views.cut_by_words(documents, [2, 5])
    assert rows(cut, "dataset", "chunk_id", "text") == [
        ("words-2", "1_0", "a b"),
        ("words-2", "1_1", "c d"),
        ("words-2", "1_2", "e"),
        ("words-5", "1_0", "a b c d e"),
    ]


def test_violations(spark, corpus):
    queries = spark.createDataFrame([("d", "q1"), ("d", "q2")], "dataset string, query_id string")
    qrels = spark.createDataFrame(
        [("d", "q1", "10_0", 0), ("d", "q1", "9_9", 1)],
        "dataset string, query_id string, target_id string, label_pos int",
    )
    vectors = corpus.withColumn(
        "vector", F.when(F.col("chunk_id") == "2_0", F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))
    )
    data = RetrievalSet(vectors.unionByName(vectors.filter("chunk_id = '10_0'")), queries, qrels)
    assert rows(checks.violations(data), "kind", "id") == [
        ("duplicate id", "10_0"),
        ("missing target", "9_9"),
        ("mixed length", "length 1"),
        ("mixed length", "length 2"),
        ("query without label", "q2"),
    ]
    bad = corpus.withColumn("chunk_id", F.lit("a_b_1"))
    assert checks.malformed_ids(bad).count() == 3 and checks.malformed_ids(corpus).count() == 0


def test_keep_last(spark):
    twice = spark.createDataFrame(
        [("d", "a", 1, "old"), ("d", "a", 5, "new"), ("d", "b", 2, "only")],
        "dataset string, chunk_id string, place int, text string",
    )
    assert rows(checks.keep_last(twice, "place"), "chunk_id", "text") == [("a", "new"), ("b", "only")]


def test_run_shape(spark, corpus):
    run = spark.createDataFrame(
        [("d", "q1", "10_0"), ("d", "q1", "10_1"), ("d", "q1", "2_0"), ("d", "q2", "2_0")],
        "dataset string, query_id string, target_id string",
    )
    qrels = spark.createDataFrame([("d", "q1"), ("d", "q2"), ("d", "q3")], "dataset string, query_id string")
    got = rows(checks.run_shape(run, corpus, qrels), "query_id", "scored", "complete")
    assert got == [("q1", 3, True), ("q2", 1, False), ("q3", 0, False)]


def test_coverage_sees_a_repeat_beside_a_hole(spark):
    corpus = spark.createDataFrame([("d", c) for c in "abc"], "dataset string, chunk_id string")
    pairs = [("full", c) for c in "abc"] + [("hole", c) for c in "aac"] + [("more", c) for c in "abcx"] + [("less", "b")]
    run = spark.createDataFrame([("d", q, t, 0.0) for q, t in pairs], "dataset string, query_id string, target_id string, score double")
    names = ("full", "hole", "more", "less", "none")
    qrels = spark.createDataFrame([("d", q, "a") for q in names] * 2, "dataset string, query_id string, target_id string")
    found = checks.run_coverage(run, corpus, qrels)
    assert rows(found, "query_id", "scored", "complete") == [
        ("full", 3, True), ("hole", 3, False), ("less", 1, False), ("more", 4, False), ("none", 0, False)
    ]
    assert rows(checks.coverage_faults(run, corpus, qrels), "query_id", "target_id", "fault", "times") == [
        ("hole", "a", "repeated", 2), ("hole", "b", "missing", 0), ("less", "a", "missing", 0), ("less", "c", "missing", 0),
        ("more", "x", "unknown", 1), ("none", "a", "missing", 0), ("none", "b", "missing", 0), ("none", "c", "missing", 0),
    ]


def test_anti_joins_meet_distinct_keys(spark):
    corpus = spark.range(5).select(F.lit("d").alias("dataset"), F.col("id").cast("string").alias("chunk_id"))
    qrels = spark.range(5000).select(
        F.lit("d").alias("dataset"), F.lit("busy").alias("query_id"), (F.col("id") % 7).cast("string").alias("target_id")
    )
    queries = spark.createDataFrame([("d", "busy"), ("d", "idle")], "dataset string, query_id string")
    missing = checks.label_violations(qrels, corpus)
    bare = checks.unlabelled_queries(queries, qrels)
    assert missing.count() == sum(1 for i in range(5000) if i % 7 > 4)
    assert rows(bare, "query_id") == [("idle",)]
    for found in (missing, bare):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        anti = plan.index("LeftAnti")
        assert "Aggregate" in plan[anti:]


def test_last_of_repeated_ids_with_ties_and_by_a_shuffle(spark, monkeypatch):
    rows_ = [("d", "a", 1, "x"), ("d", "a", 1, "y"), ("d", "a", 0, "z"), ("d", "b", 5, "b"), ("e", "a", 2, "e")]
    table = spark.createDataFrame(rows_, "dataset string, chunk_id string, place int, text string")
    for _ in range(2):
        kept = checks.keep_last(table, "place")
        assert kept.columns == table.columns
        assert rows(kept, "dataset", "chunk_id", "text") == [("d", "a", "y"), ("d", "b", "b"), ("e", "a", "e")]
        monkeypatch.setattr(checks, "SENT_IDS", 0)
    alone = table.filter("text in ('b', 'e')")
    assert checks.keep_last(alone, "place") is alone


def test_statistics_of_uneven_documents(spark):
    data = [("d", "A", 0, "A_0", "x"), ("d", "A", 1, "A_1", "x y z"), ("d", "B", 0, "B_0", "p q r s")]
    uneven = spark.createDataFrame(data, CORPUS)
    queries = spark.createDataFrame([("d", "q", "one, two")], "dataset string, query_id string, text string")
    assert stats.dataset_stats(uneven, queries).first().asDict() == {
        "dataset": "d",
        "num_queries": 1,
        "average_num_tokens_per_query": 2.0,
        "num_docs": 2,
        "average_num_tokens_per_doc": 4.0,
        "average_num_tokens_per_chunk": 3.0,
        "average_num_chunks_per_doc": 1.5,
    }


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert rows(df.select(l2_normalised(F.col("v")).alias("v"))) == [([0.0, 0.0],), ([0.6, 0.8],)]


def test_plug_in_encoder(spark, corpus):
    def factory():
        return lambda texts: [[len(t), 1] for t in texts]

    got = encode.encode(corpus.repartition(3), factory, prompt="__", batch_size=1)
    assert rows(got, "chunk_id", "vector") == [("10_0", [3.0, 1.0]), ("10_1", [7.0, 1.0]), ("2_0", [9.0, 1.0])]


def test_token_level_encoder(spark, corpus):
    got = encode.encode(corpus, encode.HashedTokens(8), token_level=True)
    sizes = {r.chunk_id: (len(r.token_vectors), len(r.token_vectors[0])) for r in got.collect()}
    assert sizes == {"10_0": (1, 8), "10_1": (3, 8), "2_0": (4, 8)}


def test_token_level_context(spark, corpus):
    def factory():
        return lambda docs: [[np.full((len(t.split()), 2), len(d)) for t in d] for d in docs]

    got = encode.encode_in_context(corpus, factory, token_level=True)
    assert rows(got, "chunk_id", "token_vectors") == [
        ("10_0", [[2.0, 2.0]]),
        ("10_1", [[2.0, 2.0]] * 3),
        ("2_0", [[1.0, 1.0]] * 4),
    ]


def test_contextual_model_is_loaded_once_per_task(spark):
    chunks = spark.range(40).select(
        F.lit("d").alias("dataset"),
        F.col("id").cast("string").alias("doc_id"),
        F.lit(0).alias("internal_id"),
        F.concat(F.col("id").cast("string"), F.lit("_0")).alias("chunk_id"),
        F.lit("text").alias("text"),
    )

    def factory():
        import uuid

        mark = float(uuid.uuid4().int % 2**20)
        return lambda docs: [[[mark] for _ in d] for d in docs]

    got = encode.encode_in_context(chunks, factory)
    marks = got.select(F.spark_partition_id().alias("p"), F.col("vector")[0].alias("m")).distinct()
    assert marks.groupBy("p").count().filter("count > 1").count() == 0


def test_hash_encoder(spark, corpus):
    got = encode.hash_encode(corpus, dim=16)
    for r in got.collect():
        assert len(r.vector) == 16 and np.linalg.norm(r.vector) == pytest.approx(1)
    empty = encode.hash_encode(corpus.withColumn("text", F.lit("...")), dim=4)
    assert {tuple(r.vector) for r in empty.collect()} == {(0.0,) * 4}
    cut = encode.hash_encode(corpus, dim=16, max_tokens=1)
    whole = encode.hash_encode(corpus.withColumn("text", F.substring("text", 1, 1)), dim=16)
    assert rows(cut, "chunk_id", "vector") == rows(whole, "chunk_id", "vector")


def test_hot_documents_are_salted(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows_ = [("d", f"hot_{i}", "hot", rng.normal(size=3).tolist()) for i in range(50)]
    rows_ += [("d", f"{i}_0", str(i), rng.normal(size=3).tolist()) for i in range(20)]
    vectors = spark.createDataFrame(rows_, "dataset string, chunk_id string, doc_id string, vector array<double>")
    plain = encode.blend_with_document(vectors)
    monkeypatch.setattr(encode, "HOT_CHUNKS", 10)
    monkeypatch.setattr(encode, "SALTS", 4)
    assert rows(encode.blend_with_document(vectors)) == rows(plain)
    assert plain.count() == 70


def test_document_means(spark):
    rows_ = [("d", "a_0", "a", [1.0, 3.0]), ("d", "a_1", "a", [3.0, 5.0]), ("d", "b_0", "b", [7.0, 0.0])]
    vectors = spark.createDataFrame(rows_, "dataset string, chunk_id string, doc_id string, vector array<double>")
    assert rows(encode.mean_over_documents(vectors), "chunk_id", "vector") == [("a", [2.0, 4.0]), ("b", [7.0, 0.0])]
    mixed = {r.chunk_id: r.vector for r in encode.blend_with_document(vectors, 0.5).collect()}
    want = np.array([2.0, 5.0]) / np.linalg.norm([2.0, 5.0])
    assert mixed["a_0"] == pytest.approx(list(want))
