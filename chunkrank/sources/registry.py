"""Names of the known evaluation sets and where each is found below a base path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkrank.schema import RetrievalSet
from chunkrank.sources.readers import read_chunked, read_length_tasks, read_triples

# Data set names, folders and splits as published. A folder of None is not published under
# a name of its own; pass a registry that tells where it is.
CHUNKED_DATASETS: dict[str, dict[str, str | None]] = {
    "football-new": {"path": "football_new"},
    "cities": {},
    "chunked-mldr": {"split": "test"},
    "covid-qa": {},
    "eiopa_europa": {},
    "narrative_qa": {"split": "test"},
    "squad-chunked-par-100": {"split": "validation"},
    "restaurants": {"path": None, "split": "test"},
}
CHUNK_SIZE_VARIANTS = (8000, 1000, 500, 300, 250, 200, 175, 150, 125, 100)
TRIPLE_TASKS = (
    "NanoClimateFEVER",
    "NanoDBPedia",
    "NanoFEVER",
    "NanoFiQA2018",
    "NanoHotpotQA",
    "NanoMSMARCO",
    "NanoNFCorpus",
    "NanoNQ",
    "NanoQuoraRetrieval",
    "NanoSCIDOCS",
    "NanoArguAna",
    "NanoSciFact",
    "NanoTouche2020",
)
LENGTH_TASKS = ("summ_screen_fd", "narrativeqa", "2wikimqa", "qmsum", "needle", "passkey")
MULTI_LENGTH_TASKS = ("needle", "passkey")
CONTEXT_LENGTHS = (32768, 16384, 8192, 4096, 2048, 1024, 512, 256)

REGISTRY_SCHEMA = "dataset string, path string, split string, query_key string"


def registry_frame(
    spark: SparkSession, registry: Mapping[str, Mapping[str, str | None]] = CHUNKED_DATASETS
) -> DataFrame:
    """The registry with its defaults filled in: path = name, split = train."""
    rows = [
        (name, entry.get("path", name), entry.get("split", "train"), entry.get("query_key", "queries"))
        for name, entry in registry.items()
    ]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def resolve(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested data sets with their location, ``skipped`` for unknown names, ``no folder`` without one."""
    names = requested.select("dataset").distinct()
    status = F.when(F.col("split").isNull(), "skipped").when(F.col("path").isNull(), "no folder").otherwise("run")
    return names.join(registry, "dataset", "left").withColumn("status", status)


def empty_set(spark: SparkSession) -> RetrievalSet:
    """No data set at all: evaluates to no metrics."""
    name = "dataset string, "
    return RetrievalSet(
        spark.createDataFrame([], name + "doc_id string, internal_id int, chunk_id string, text string"),
        spark.createDataFrame([], name + "query_id string, query_pos long, text string"),
        spark.createDataFrame([], name + "query_id string, target_id string, label_pos int"),
    )


def merge(sets: Sequence[RetrievalSet]) -> RetrievalSet:
    """Many tasks as one, so that they are evaluated in one job."""
    return reduce(RetrievalSet.union, sets)


def load_chunked_suite(
    spark: SparkSession,
    base: str,
    names: Sequence[str] | None = None,
    registry: Mapping[str, Mapping[str, str | None]] = CHUNKED_DATASETS,
    fmt: str = "parquet",
) -> tuple[RetrievalSet, list[str]]:
    """All known names merged into one set, and the names skipped as unknown.

    A known name without a folder is an error: leave it out, or register where it is.
    """
    names = list(registry) if names is None else list(names)
    known = [n for n in names if n in registry]
    for name in known:
        if registry[name].get("path", name) is None:
            raise ValueError(f"no folder is registered for {name!r}: pass a registry with its path, or other names")
    sets = [
        read_chunked(
            spark,
            f"{base}/{registry[n].get('path', n)}",
            registry[n].get("split", "train"),
            registry[n].get("query_key", "queries"),
            dataset=n,
            fmt=fmt,
        )
        for n in known
    ]
    skipped = [n for n in names if n not in registry]
    if not sets:
        return empty_set(spark), skipped
    return merge(sets), skipped


def load_chunk_size_suite(
    spark: SparkSession, base: str, sizes: Sequence[int] = CHUNK_SIZE_VARIANTS, fmt: str = "parquet"
) -> RetrievalSet:
    """Ready-made variants of one text collection, cut at different chunk sizes."""
    return merge(
        [
            read_chunked(
                spark,
                f"{base}/squad-chunked-par-{size}",
                "validation",
                dataset=f"squad-chunked-par{size}",
                fmt=fmt,
            )
            for size in sizes
        ]
    )


def load_triple_suite(
    spark: SparkSession,
    base: str,
    tasks: Sequence[str] = TRIPLE_TASKS,
    query_prompt: str = "",
    doc_prompt: str = "",
    fmt: str = "parquet",
) -> RetrievalSet:
    return merge(
        [
            read_triples(
                spark,
                f"{base}/{task}",
                "train",
                query_prompt=query_prompt,
                doc_prompt=doc_prompt,
                dataset=task,
                fmt=fmt,
            )
            for task in tasks
        ]
    )


def load_length_suite(
    spark: SparkSession,
    base: str,
    tasks: Sequence[str] = LENGTH_TASKS,
    multi_length_tasks: Sequence[str] = MULTI_LENGTH_TASKS,
    context_lengths: Sequence[int] = CONTEXT_LENGTHS,
    query_prompt: str = "",
    fmt: str = "parquet",
) -> RetrievalSet:
    return merge(
        [
            read_length_tasks(
                spark,
                base,
                task,
                context_lengths if task in multi_length_tasks else None,
                query_prompt=query_prompt,
                fmt=fmt,
            )
            for task in tasks
        ]
    )
