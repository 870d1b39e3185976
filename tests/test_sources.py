"""Source layouts, id rules, registry and sinks."""

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from chunkrank.functions import ids
from chunkrank.operators import checks, encode, stats, views
from chunkrank.plans.evaluate import evaluate
from chunkrank.schema import SchemaError
from chunkrank.sources import positions, readers, registry, sinks


def write(spark, path, rows_, schema):
    spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(path))


@pytest.fixture
def chunked(spark, tmp_path):
    write(
        spark,
        tmp_path / "set/documents/train",
        [("a_0", "one", "ONE"), ("a_1", "two", "TWO"), ("b_0", "three", "THREE")],
        "chunk_id string, chunk string, og_chunk string",
    )
    write(
        spark,
        tmp_path / "set/queries/train",
        [("first", "a_1"), ("second", "b_0")],
        "query string, chunk_id string",
    )
    return str(tmp_path / "set")


def test_chunked_source(spark, chunked):
    data = readers.read_chunked(spark, chunked, query_prompt="q: ", doc_prompt="d: ")
    assert rows(data.corpus, "dataset", "doc_id", "internal_id", "chunk_id", "text", "og_text") == [
        ("set", "a", 0, "a_0", "one", "ONE"),
        ("set", "a", 1, "a_1", "two", "TWO"),
        ("set", "b", 0, "b_0", "three", "THREE"),
    ]
    assert rows(data.queries, "query_id", "query_pos", "text") == [("0", 0, "first"), ("1", 1, "second")]
    flat = views.with_prompts(data)
    assert rows(flat.corpus, "text") == [("d: one",), ("d: three",), ("d: two",)]
    assert rows(flat.queries, "text") == [("q: first",), ("q: second",)]
    # A prompt is put there once, and nothing is left to put.
    assert rows(views.with_prompts(flat).queries, "text") == [("q: first",), ("q: second",)]
    assert rows(data.qrels, "query_id", "target_id", "label_pos") == [("0", "a_1", 0), ("1", "b_0", 0)]


def test_swap_comes_before_the_prompt(spark, chunked):
    data = readers.read_chunked(spark, chunked, doc_prompt="d: ", og_ratio=1.0)
    assert rows(views.with_prompts(data).corpus, "text") == [("d: ONE",), ("d: THREE",), ("d: TWO",)]
    some = readers.read_chunked(spark, chunked, og_ratio=0.5, seed=7)
    whole = readers.read_chunked(spark, chunked)
    assert rows(some.corpus, "text") == rows(views.swap_chunks(whole.corpus, 0.5, 7), "text")


def test_nested_views_take_no_prompt(spark, chunked):
    data = readers.read_chunked(spark, chunked, query_prompt="q: ", doc_prompt="d: ")
    inside = views.with_prompts(data, by_document=True, nested_queries=True)
    assert rows(views.nested(inside.corpus).select("doc_id", F.concat_ws("|", "texts").alias("t"))) == [("a", "one|two"), ("b", "three")]
    assert rows(inside.queries, "text") == [("first",), ("second",)]
    counted = stats.set_stats(data).first()
    assert counted.average_num_tokens_per_doc == 1.5 and counted.average_num_tokens_per_query == 2.0


def test_chunks_without_documents_keep_their_prompt_beside_nested_ones(spark, chunked, tmp_path):
    task = tmp_path / "NanoNQ"
    write(spark, task / "corpus/train", [("x_1", "alone"), ("x_2", "too")], "_id string, text string")
    write(spark, task / "queries/train", [("q1", "ask")], "_id string, text string")
    write(spark, task / "qrels/train", [("q1", "x_1")], "`query-id` string, `corpus-id` string")
    triples = registry.load_triple_suite(spark, str(tmp_path), ["NanoNQ"], query_prompt="> ", doc_prompt="t: ")
    both = readers.read_chunked(spark, chunked, doc_prompt="d: ").union(triples)
    seen = views.with_prompts(both, by_document=True).corpus
    assert rows(seen, "text") == [("one",), ("t: alone",), ("t: too",), ("three",), ("two",)]
    sizes = lambda: lambda documents: [[[float(len(d))] for _ in d] for d in documents]
    found = encode.encode_in_context(seen, sizes)
    assert rows(found, "chunk_id", "vector") == [("a_0", [2.0]), ("a_1", [2.0]), ("b_0", [1.0]), ("x_1", [1.0]), ("x_2", [1.0])]


def several_files(spark, path, sizes, schema, row, fmt="parquet"):
    """Files of the given numbers of rows, in the order of their names, numbered through."""
    done = 0
    for i, n in enumerate(sizes):
        part = path / f"tmp{i}"
        spark.createDataFrame([row(done + j) for j in range(n)], schema).coalesce(1).write.format(fmt).save(str(part))
        file = next(p for p in part.iterdir() if p.name.startswith("part-"))
        path.joinpath("train").mkdir(parents=True, exist_ok=True)
        file.rename(path / f"train/{i:03d}.{fmt}")
        done += n


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_files_of_different_size_are_numbered_in_file_order(spark, tmp_path, chunked, fmt):
    several_files(spark, tmp_path / "many", [3, 3000, 5], "query string, chunk_id string", lambda i: (f"text {i}", "a_1"), fmt)
    scan = readers.open_table(spark, str(tmp_path / "many/train"), fmt, in_order=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("8k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            numbered = readers.with_row_position(scan, "place")
            assert numbered.count() == 3008
            assert numbered.filter("query <> concat('text ', place)").count() == 0
            some = readers.with_row_position(scan.filter("query not like '%7'"), "place")
            with pytest.raises(Exception, match="before they are filtered"):
                some.collect()
            left = positions.numbered_within(scan.filter("query like '%7'"), ["chunk_id"], F.col("_at"), "place")
            assert left.filter("query <> concat('text ', 10 * place + 7)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbers_inside_groups_of_any_size(spark):
    rows_ = spark.range(0, 5000, 1, 9).select(
        F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("dataset"),
        (F.lit(10_000) - F.col("id")).alias("at"),
    )
    numbered = positions.numbered_within(rows_, ["dataset"], F.col("at"), "place")
    wanted = rows_.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy("at")) - 1)
    assert rows(numbered, "dataset", "at", "place") == rows(wanted, "dataset", "at", "place")
    again = positions.numbered_within(numbered, ["dataset"], F.col("place"), "place")
    assert rows(again, "dataset", "at", "place") == rows(wanted, "dataset", "at", "place")


def test_the_last_of_repeated_ids_counts_from_files(spark, tmp_path):
    base = tmp_path / "twice"
    chunks = [("a_0", "gold"), ("b_0", "other"), ("a_0", "nothing"), ("b_0", "gold here")]
    write(spark, base / "documents/train", chunks, "chunk_id string, chunk string")
    write(spark, base / "queries/train", [("gold", "b_0")], "query string, chunk_id string")
    data = readers.read_chunked(spark, str(base))
    kept = checks.keep_last(data.corpus, "chunk_pos")
    assert rows(kept, "chunk_id", "text") == [("a_0", "nothing"), ("b_0", "gold here")]
    assert kept.columns == data.corpus.columns
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    found = {r.metric: r.value for r in evaluate(data, "bm25").collect()}
    assert found["recall_at_1"] == 1.0


def test_many_labels_per_query(spark, tmp_path, chunked):
    write(
        spark,
        tmp_path / "set/many/train",
        [("both", ["a_1", "b_0"])],
        "query string, chunk_ids array<string>",
    )
    data = readers.read_chunked(spark, chunked, query_key="many")
    assert rows(data.qrels, "query_id", "target_id", "label_pos") == [("0", "a_1", 0), ("0", "b_0", 1)]
    assert rows(data.queries, "doc_id", "internal_ids") == [("a", [1, 0])]


def test_row_positions_follow_the_scan(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id").alias("value"))
    numbered = readers.with_row_position(df, "place")
    assert numbered.filter("place <> value").count() == 0


def test_queries_of_a_file_are_numbered_in_order(spark, tmp_path, chunked):
    many = [(f"text {i}", "a_1") for i in range(500)]
    write(spark, tmp_path / "set/long/train", many, "query string, chunk_id string")
    data = readers.read_chunked(spark, chunked, query_key="long")
    got = {r.query_id: r.text for r in data.queries.collect()}
    assert got == {str(i): text for i, (text, _) in enumerate(many)}


@pytest.mark.parametrize("bad", ["a_b_1", "a", "a_x"])
def test_bad_ids_fail(spark, bad):
    df = spark.createDataFrame([(bad,)], "chunk_id string")
    with pytest.raises(Exception, match="chunk id"):
        df.select(ids.document_of(F.col("chunk_id")), ids.number_of(F.col("chunk_id"))).collect()
    assert df.filter(ids.well_formed(F.col("chunk_id"))).count() == 0


def test_only_the_first_listed_id_is_held_to_one_underscore(spark):
    df = spark.createDataFrame([(["a_1", "b_2_x"],)], "chunk_ids array<string>")
    got = df.select(ids.document_of_list(F.col("chunk_ids")), ids.numbers_of_list(F.col("chunk_ids"))).first()
    assert tuple(got) == ("a", [1, 2])
    empty = spark.createDataFrame([([],)], "chunk_ids array<string>")
    with pytest.raises(Exception):
        empty.select(ids.document_of_list(F.col("chunk_ids"))).collect()


def test_ids_without_underscore(spark):
    df = spark.createDataFrame([("plain",), ("a_b_3",)], "id string")
    got = rows(df.select(ids.parent_id(F.col("id")).alias("p"), ids.position(F.col("id")).alias("n")))
    assert got == [("a", "3"), ("plain", "plain")]


def test_missing_columns_fail_when_opened(spark):
    df = spark.createDataFrame([("x",)], "query string")
    docs = spark.createDataFrame([("a_0", "t")], "chunk_id string, chunk string")
    with pytest.raises(SchemaError):
        readers.chunked_tables(docs, df, "d")
    with pytest.raises(SchemaError):
        readers.triple_tables(docs, df, df, "d")


def test_null_text_fails(spark):
    docs = spark.createDataFrame([("a_0", None)], "chunk_id string, chunk string")
    queries = spark.createDataFrame([("q", "a_0")], "query string, chunk_id string")
    with pytest.raises(Exception, match="null chunk"):
        readers.chunked_tables(docs, queries, "d").corpus.collect()


def test_triples(spark, tmp_path):
    base = tmp_path / "NanoNQ"
    write(spark, base / "corpus/train", [("d1", "x", "t"), ("d2", "y", "t")], "_id string, text string, title string")
    write(spark, base / "queries/train", [("q1", "ask")], "_id string, text string")
    labels = [("q1", "d1", 0), ("q1", "d2", 1)]
    write(spark, base / "qrels/train", labels, "`query-id` string, `corpus-id` string, score int")
    data = registry.load_triple_suite(spark, str(tmp_path), ["NanoNQ"], query_prompt="> ")
    assert rows(data.corpus, "dataset", "chunk_id", "text") == [("NanoNQ", "d1", "x"), ("NanoNQ", "d2", "y")]
    assert rows(views.with_prompts(data).queries, "query_id", "text") == [("q1", "> ask")]
    # a score of 0 is still a label
    assert rows(data.qrels, "target_id", "label_pos") == [("d1", 0), ("d2", 1)]


def test_length_tasks(spark, tmp_path):
    base = tmp_path / "needle"
    write(
        spark,
        base / "corpus",
        [("d1", "x", 256), ("d2", "y", 512), ("d3", "z", 99)],
        "doc_id string, text string, context_length int",
    )
    write(spark, base / "queries", [("12560_512", "ask"), ("7_256", "tell")], "qid string, text string")
    write(spark, base / "qrels", [("12560_512", "d2"), ("7_256", "d1")], "qid string, doc_id string")
    data = readers.read_length_tasks(spark, str(tmp_path), "needle", [512, 256], query_prompt="> ")
    assert rows(data.corpus, "dataset", "chunk_id", "text") == [("needle_256", "d1", "x"), ("needle_512", "d2", "y")]
    # 12560 contains the digits 256, so the query counts in both buckets
    assert rows(views.with_prompts(data).queries, "dataset", "query_id", "query_pos", "text") == [
        ("needle_256", "12560_512", 0, "> ask"),
        ("needle_256", "7_256", 1, "> tell"),
        ("needle_512", "12560_512", 0, "> ask"),
    ]
    assert rows(views.with_prompts(data).corpus, "text") == [("x",), ("y",)]
    whole = readers.read_length_tasks(spark, str(tmp_path), "needle")
    assert whole.corpus.count() == 3 and rows(whole.queries, "dataset") == [("needle",), ("needle",)]


def test_json_source(spark, tmp_path):
    from chunkrank import schema

    for name, row in {"corpus": {"_id": "d", "text": "t"}, "queries": {"_id": "q", "text": "a"}}.items():
        spark.createDataFrame([row]).write.json(str(tmp_path / f"{name}/train"))
    labels = spark.createDataFrame([("q", "d")], schema.TRIPLE_LABELS)
    labels.write.json(str(tmp_path / "qrels/train"))
    schemas = {"corpus": schema.TRIPLE_TEXTS, "queries": schema.TRIPLE_TEXTS, "qrels": schema.TRIPLE_LABELS}
    data = readers.read_triples(spark, str(tmp_path), fmt="json", schemas=schemas, dataset="j")
    assert rows(data.qrels, "query_id", "target_id") == [("q", "d")]


def test_registry(spark, chunked):
    assert len(registry.CHUNKED_DATASETS) == 8 and len(registry.TRIPLE_TASKS) == 13
    assert len(registry.LENGTH_TASKS) == 6 and len(registry.CONTEXT_LENGTHS) == 8
    frame = registry.registry_frame(spark)
    found = {r.dataset: (r.path, r.split, r.query_key) for r in frame.collect()}
    assert found["football-new"] == ("football_new", "train", "queries")
    assert found["cities"] == ("cities", "train", "queries")
    asked = spark.createDataFrame([("cities",), ("nowhere",), ("restaurants",)], "dataset string")
    assert rows(registry.resolve(asked, frame), "dataset", "status") == [
        ("cities", "run"), ("nowhere", "skipped"), ("restaurants", "no folder")
    ]
    with pytest.raises(ValueError, match="no folder is registered for 'restaurants'"):
        registry.load_chunked_suite(spark, "nowhere", ["restaurants"])
    base, name = chunked.rsplit("/", 1)
    data, skipped = registry.load_chunked_suite(spark, base, ["renamed", "other"], {"renamed": {"path": name}})
    assert skipped == ["other"] and rows(data.qrels, "dataset") == [("renamed",), ("renamed",)]


def test_sink_keeps_suites_apart(spark, tmp_path):
    about = sinks.run_metadata(spark, "p", "n", "dense", use_prefix=True, runtime=1.5)
    schema = "dataset string, metric string, value double"
    first = spark.createDataFrame([("a", "ndcg_at_10", 0.5)], schema)
    second = spark.createDataFrame([("b", "ndcg_at_10", 0.25)], schema)
    target = sinks.write_metrics(first, about, str(tmp_path), "n", "dense", "main")
    sinks.write_metrics(second, about, str(tmp_path), "n", "dense", "triples")
    sinks.write_metrics(first.withColumn("value", F.lit(0.75)), about, str(tmp_path), "n", "dense", "main")
    assert target.endswith("metrics_n_dense.json")
    assert rows(sinks.read_metrics(spark, target), "dataset", "value", "suite") == [
        ("a", 0.75, "main"),
        ("b", 0.25, "triples"),
    ]
    assert spark.read.json(f"{target}/run").first().use_prefix is True


def test_run_suites(spark, tmp_path, chunked):
    from chunkrank.plans.suites import run_suites

    base, name = chunked.rsplit("/", 1)
    task = tmp_path / "nanobeir/NanoNQ"
    write(spark, task / "corpus/train", [("d1", "x y"), ("d2", "y z")], "_id string, text string")
    write(spark, task / "queries/train", [("q1", "z")], "_id string, text string")
    write(spark, task / "qrels/train", [("q1", "d2")], "`query-id` string, `corpus-id` string")
    length = tmp_path / "LongEmbed/needle"
    write(spark, length / "corpus", [("d1", "x", 256), ("d2", "y", 512)], "doc_id string, text string, context_length int")
    write(spark, length / "queries", [("7_256", "x"), ("8_512", "y")], "qid string, text string")
    write(spark, length / "qrels", [("7_256", "d1"), ("8_512", "d2")], "qid string, doc_id string")
    target, skipped = run_suites(
        spark,
        base,
        str(tmp_path / "out"),
        "none",
        "words",
        "bm25",
        names=["mine", "missing"],
        known={"mine": {"path": name}},
        triple_tasks=["NanoNQ"],
        length_tasks=["needle"],
    )
    assert skipped == ["missing"]
    found = {(r.suite, r.dataset, r.metric): r.value for r in sinks.read_metrics(spark, target).collect()}
    assert found["triples", "NanoNQ", "ndcg_at_1"] == 1.0
    assert found["lengths", "needle_avg", "recall_at_1"] == 1.0
    assert found["main", "mine", "runtime"] > 0
    assert {s for s, _, _ in found} == {"main", "triples", "lengths"}
