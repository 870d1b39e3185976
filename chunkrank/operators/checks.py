"""Rule violations and coverage as DataFrames: empty means the input is sound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkrank.functions import ids
from chunkrank.schema import RetrievalSet, one_per_dataset
from chunkrank.session import materialised


def label_violations(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Labels whose target is not in the corpus.

    Targets and ids meet as distinct keys, so a target that very many labels name is one row. Only the
    targets that are missing meet the labels again.
    """
    target = ["dataset", "target_id"]
    known = corpus.select("dataset", F.col("chunk_id").alias("target_id")).distinct()
    missing = qrels.select(*target).distinct().join(known, target, "left_anti")
    return qrels.join(missing, target, "left_semi").select("dataset", "query_id", "target_id")


def unlabelled_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries without a label; a query with very many is one key."""
    name = ["dataset", "query_id"]
    return queries.select(*name).join(qrels.select(*name).distinct(), name, "left_anti")


def labelled_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with their labels, one row per label."""
    return queries.join(qrels, ["dataset", "query_id"])


def evaluated_queries(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that count in the means: those in both the run and the labels."""
    names = ["dataset", "query_id"]
    return qrels.select(*names).distinct().join(run.select(*names), names, "left_semi")


def duplicate_ids(corpus: DataFrame) -> DataFrame:
    return (
        corpus.groupBy("dataset", "chunk_id")
        .agg(F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )


#: Repeated ids that are sent to every task; more of them meet the corpus by a shuffle.
SENT_IDS = 1_000_000


def keep_last(corpus: DataFrame, order_by: str) -> DataFrame:
    """Of chunks sharing an id keep the last by ``order_by``.

    Only (id, position) is shuffled to find the ids that repeat and their last positions. The corpus
    then loses its earlier copies where it is read: no text or vector moves.
    """
    name = ["dataset", "chunk_id"]
    last = corpus.groupBy(*name).agg(F.count(F.lit(1)).alias("_copies"), F.max(order_by).alias("_last"))
    repeated = materialised(last.filter("_copies > 1").select(*name, "_last"))
    found = repeated.count()
    if not found:
        return corpus
    if found <= SENT_IDS:
        repeated = F.broadcast(repeated)
    held = corpus.join(repeated, name, "left").filter(F.col("_last").isNull() | F.col(order_by).eqNullSafe(F.col("_last")))
    if isinstance(corpus.schema[order_by].dataType, T.StructType):
        return held.select(*corpus.columns)  # the place in a file, which no two rows share
    # Copies that tie for the last place: one of them, told by its content.
    tied = held.filter(F.col("_last").isNotNull()).groupBy(*name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = held.select(*corpus.columns)
    if tied.isEmpty():
        return held
    rest = [c for c in corpus.columns if c not in name]
    latest = F.max(F.struct(order_by, *[c for c in rest if c != order_by])).alias("_last")
    return held.groupBy(*name).agg(latest).select(*name, "_last.*").select(*corpus.columns)


def malformed_ids(corpus: DataFrame) -> DataFrame:
    return corpus.filter(~ids.well_formed(F.col("chunk_id"))).select("dataset", "chunk_id")


def vector_lengths(vectors: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Count per vector length; more than one row per data set cannot be stacked."""
    return vectors.groupBy(*keys, F.size("vector").alias("dim")).agg(F.count("*").alias("vectors"))


def run_shape(run: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """Completeness of a supplied run: scored chunks per labelled query against the corpus size."""
    sizes = corpus.groupBy("dataset").agg(F.count("*").alias("chunks"))
    scored = run.groupBy("dataset", "query_id").agg(F.count("*").alias("scored"))
    asked = qrels.select("dataset", "query_id").distinct()
    return (
        asked.join(scored, ["dataset", "query_id"], "full")
        .join(one_per_dataset(sizes), "dataset")
        .select(
            "dataset",
            "query_id",
            F.coalesce("scored", F.lit(0)).alias("scored"),
            "chunks",
            (F.coalesce("scored", F.lit(0)) == F.col("chunks")).alias("complete"),
        )
    )


def _digest(ids_: Column) -> list[Column]:
    """Count, sum and xor of 64-bit hashes: equal for equal lists of ids, in whatever order."""
    hashed = F.xxhash64(ids_)
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(hashed.cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(hashed).alias("xor"),
    ]


def run_coverage(run: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """Whether a supplied run scores every chunk once for each query: (dataset, query_id, scored, chunks, complete).

    Ids are compared by count, sum and xor of their hashes, so a run with one chunk twice and another
    missing is not complete. Everything combines before the shuffle; no pair meets the corpus.
    """
    whole = corpus.groupBy("dataset").agg(*_digest(F.col("chunk_id")))
    whole = whole.select("dataset", F.col("n").alias("chunks"), F.col("sum").alias("_sum"), F.col("xor").alias("_xor"))
    each = run.groupBy("dataset", "query_id").agg(*_digest(F.col("target_id")))
    asked = qrels.select("dataset", "query_id").distinct()
    same = (F.col("n") == F.col("chunks")) & (F.col("sum") == F.col("_sum")) & (F.col("xor") == F.col("_xor"))
    return (
        asked.join(each, ["dataset", "query_id"], "full")
        .join(one_per_dataset(whole), "dataset")
        .select(
            "dataset",
            "query_id",
            F.coalesce("n", F.lit(0)).alias("scored"),
            "chunks",
            F.coalesce(same, F.lit(False)).alias("complete"),
        )
    )


COVERAGE_SALTS = 64


def coverage_faults(run: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """Every fault of an incomplete run: (dataset, query_id, target_id, fault, times).

    ``missing`` chunks have no score, ``repeated`` ones several, ``unknown`` targets are no chunk. Only
    the queries that ``run_coverage`` finds incomplete are looked at; they meet the chunks in parts.
    """
    pair = ["dataset", "query_id", "target_id"]
    open_ = materialised(run_coverage(run, corpus, qrels).filter(~F.col("complete")).select("dataset", "query_id"))
    seen = run.join(open_, ["dataset", "query_id"], "left_semi").groupBy(*pair).agg(F.count(F.lit(1)).alias("times"))
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(COVERAGE_SALTS)).cast("int").alias("salt")
    chunks = corpus.select("dataset", F.col("chunk_id").alias("target_id"), salt).distinct()
    every = F.explode(F.sequence(F.lit(0), F.lit(COVERAGE_SALTS - 1))).alias("salt")
    wanted = open_.select("dataset", "query_id", every).join(chunks, ["dataset", "salt"]).select(*pair, F.lit(True).alias("chunk"))
    fault = (
        F.when(F.col("times").isNull(), "missing").when(F.col("chunk").isNull(), "unknown").when(F.col("times") > 1, "repeated")
    )
    both = wanted.join(seen, pair, "full").select(*pair, fault.alias("fault"), F.coalesce("times", F.lit(0)).alias("times"))
    return both.filter(F.col("fault").isNotNull())


def violations(data: RetrievalSet) -> DataFrame:
    """Every violated rule as (kind, dataset, id)."""

    def tagged(kind: str, rows: DataFrame, id_name: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "dataset", F.col(id_name).alias("id"))

    found = [
        tagged("missing target", label_violations(data.qrels, data.corpus), "target_id"),
        tagged("query without label", unlabelled_queries(data.queries, data.qrels), "query_id"),
        tagged("duplicate id", duplicate_ids(data.corpus), "chunk_id"),
    ]
    if "vector" in data.corpus.columns:
        lengths = vector_lengths(data.corpus)
        kinds = F.count("*").over(Window.partitionBy("dataset"))
        mixed = lengths.withColumn("kinds", kinds).filter("kinds > 1")
        mixed = mixed.withColumn("id", F.concat(F.lit("length "), F.col("dim").cast("string")))
        found.append(tagged("mixed length", mixed, "id"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
