"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from chunkrank.llm import (
    archives,
    exact,
    filter_audit,
    fuzzy_lines,
    main_text,
    near_dups,
    packing,
    quality,
    secrets,
    source_audit,
    sql,
    substrings,
    subwords,
    suffix_arrays,
)
from chunkrank.llm.tables import read, vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by the merge-type vocabulary, as digests, and of what they decode to."""
    return subwords.digests(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page, without what surrounds it."""
    return main_text.extracted(read(spark, sf_dir, "pages"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document, and the one of each class that stays."""
    return near_dups.classes(read(spark, sf_dir, "documents")).drop("place")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back, in the order of the merged capture index."""
    index = archives.archived(read(spark, sf_dir, "pages"))
    return index.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "part", "place"
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document, and the one of each group that stays."""
    return exact.marked(read(spark, sf_dir, "documents")).drop("place")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word windows that start earlier too."""
    return substrings.cleaned(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether base rules and adaptive fences keep it."""
    return quality.judged(read(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept"
    )


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by fixed patterns and by entropy."""
    return secrets.summaries(read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4,096 tokens."""
    return packing.packed(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that are nearly the same as one kept elsewhere."""
    found = fuzzy_lines.cleaned(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set each source apart."""
    return source_audit.audited(read(spark, sf_dir, "documents"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that documents of smaller ids hold."""
    return suffix_arrays.cleaned(read(spark, sf_dir, "documents"))


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five quality filters in all orders: what each step keeps, removes and loses, per language."""
    return filter_audit.audited(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


REGISTERED: tuple[Query, ...] = (
    op1_sentencepiece,
    op2_main_text,
    op3_minhash_near_dedup,
    op4_warc,
    op5_exact_dedup,
    op6_substring_dedup,
    op7_quality_rules,
    op8_secret_scans,
    op9_best_fit_packing,
    op10_line_dedup,
    op11_source_divergence,
    op12_suffix_array_dedup,
    op13_filter_interaction,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in REGISTERED} | {"pipeline": corpus_pipeline.run}


OP5_SQL = r"""
WITH texts AS (
    SELECT doc_id, length(coalesce(text, '')) AS points, row_number() OVER () AS place,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest
    FROM documents
), ranked AS (
    SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS nth,
        count(*) OVER (PARTITION BY digest) AS group_size
    FROM texts WINDOW w AS (PARTITION BY digest ORDER BY points DESC, doc_id NULLS LAST, place)
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, digest AS text_sha256 FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": OP5_SQL,
        "op11_source_divergence": sql.SOURCE_AUDIT,
        "op12_suffix_array_dedup": sql.SUFFIX_ARRAY_DEDUP,
        "op13_filter_interaction": sql.FILTER_AUDIT,
    }
