"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chunkrank.llm import (
    archives,
    exact,
    fuzzy_lines,
    main_text,
    near_dups,
    packing,
    quality,
    secrets,
    substrings,
    subwords,
)
from chunkrank.llm.tables import vocabulary

PROSE = " ".join(f"word{i % 97}x{i % 13}" for i in range(300))
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(30_000))
ROWS = [
    (1, PROSE, "en", "a", len(PROSE)),
    (2, PROSE, "en", "a", len(PROSE)),
    (2, PROSE, "en", "a", len(PROSE)),
    (3, None, None, None, None),
    (None, "", "en", None, 0),
    (None, None, None, "a", None),
    (4, " \n\t ", "en", "a", 4),
    (5, "token = 'abcdefgh1234'", "en", "a", 22),
    (6, LONG, "de", "b", len(LONG)),
    (7, "ein wort", "de", "b", 8),
    (7, PROSE + " more", "en", "a", None),
    (8, "é" * 5000, "fr", "c", 5000),
]
CLASHES = (
    "row place kept digest node n_words key first lane rows size kinds starts ends ids part length rank anchors hot "
    "whole fences cell_lang own class_id component line_no norm value header raw payload file run url_key text_sha256"
).split()


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(r[0], f"http://a.org/{r[2]}", r[1]) for r in ROWS] + [(9, None, "<p>x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("x") for c in CLASHES}
    )


OF_DOCUMENTS = {
    "encode": lambda d: subwords.digests(d, vocabulary("piece_bpe_32k.model")),
    "encode ids": lambda d: subwords.encoded(d, vocabulary("piece_bpe_32k.model"), check="texts"),
    "near": near_dups.classes,
    "exact": exact.marked,
    "substrings": substrings.cleaned,
    "quality": quality.judged,
    "secrets": secrets.summaries,
    "lines": fuzzy_lines.cleaned,
}
FILTERS = {
    "near": near_dups.kept_documents,
    "exact": exact.kept_documents,
    "quality": quality.kept_documents,
    "secrets": secrets.masked,
}


@pytest.mark.parametrize("name", sorted(OF_DOCUMENTS))
def test_one_row_per_document(odd, name):
    assert OF_DOCUMENTS[name](odd).count() == len(ROWS)
    assert OF_DOCUMENTS[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_stages_keep_the_columns(odd, name):
    out = FILTERS[name](odd)
    assert out.columns == odd.columns
    assert out.select("row", "kept").distinct().collect() == [("x", "x")]
    assert FILTERS[name](odd.limit(0)).count() == 0


def test_exact(odd):
    found = exact.marked(odd).collect()
    same = [r for r in found if r.text_sha256 == hashlib.sha256(PROSE.replace(" ", "").encode()).hexdigest()]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in same) == [
        (1, 1, 3, True),
        (2, 1, 3, False),
        (2, 1, 3, False),
    ]
    empty = [r for r in found if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 4 and {r.keep_id for r in empty} == {4} and sum(r.kept for r in empty) == 1


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert [r.kept for r in exact.marked(docs).collect()].count(True) == 1
    assert [r.kept for r in near_dups.classes(docs).collect()].count(True) == 1
    assert exact.kept_documents(docs).count() == near_dups.kept_documents(docs).count() == 1


def test_near(odd):
    found = near_dups.classes(odd).collect()
    assert {r.class_id for r in found if r.class_size > 1} == {1}
    assert sum(r.class_size == 4 for r in found) == 4  # PROSE three times and with one word more
    assert sum(r.kept for r in found) == len(ROWS) - 3


def test_null_texts_are_empty(odd):
    for r in secrets.summaries(odd.filter("doc_id = 3")).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.spans) == (0, 0, 0, "")
        assert r.base_sha256 == hashlib.sha256(b"").hexdigest()
    for r in quality.judged(odd.filter("doc_id = 3")).collect():
        assert (r.n_words, r.base_failed, r.kept) == (0, True, False)


def test_masked(odd):
    texts = {r.doc_id: r for r in secrets.masked(odd).collect()}
    assert texts[5].text == "[SECRET]'" and texts[5].n_chars == len("[SECRET]'")
    assert texts[3].text is None and texts[3].n_chars is None
    assert texts[1].text == PROSE


def test_packing(odd):
    packed = packing.packed(odd, vocabulary("word_bpe_49k.json"))
    rows = packed.collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert [r.length for r in rows if r.doc_id == 3] == [1]
    assert packing.packed(odd.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_pages(pages):
    found = archives.archived(pages)
    assert found.count() == len(ROWS) + 1
    empty = [r for r in found.collect() if r.payload_bytes == 0]
    assert sorted((r.page_id is None, r.record_type, r.refers_to) for r in empty) == [
        (False, "response", None),
        (True, "revisit", 3),
        (True, "revisit", 3),
    ]
    assert archives.archived(pages.limit(0)).count() == 0
    texts = main_text.extracted(pages)
    assert texts.count() == len(ROWS) + 1
    assert texts.filter("text is null or n_chars <> char_length(text)").isEmpty()
    assert main_text.extracted(pages.limit(0)).count() == 0


def test_negative_page_ids(spark):
    rows = [(-5, "http://a.org", "same"), (3, "http://a.org", "same"), (-7, "http://b.org", "other")]
    found = archives.archived(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found.collect()) == [
        (-7, "response", None),
        (-5, "response", None),
        (3, "revisit", -5),
    ]


NOTHING = [(None, None, None, None, None)] * 3
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [[], NOTHING], ids=["empty", "nulls"])
def test_pipeline_on_tables_with_nothing(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_clashing_columns(odd, spark, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


LETTERS = {"mixed": string.ascii_letters, "lower": string.ascii_lowercase, "upper": string.ascii_uppercase}


@pytest.mark.parametrize(("size", "share"), [(20, 0.55), (24, 0.7), (32, 0.8), (40, 0.85)])
@pytest.mark.parametrize("kind", sorted(LETTERS))
@pytest.mark.parametrize("counter", ["", "-123"])
def test_secrets_of_letters_are_found(kind, size, share, counter):
    rnd = random.Random(size)
    runs = ["".join(rnd.choice(LETTERS[kind]) for _ in range(size)) + counter for _ in range(300)]
    found = sum(any(k == 3 for _, _, k in secrets.spans(f"a word {run}, another".encode())) for run in runs)
    assert found >= share * len(runs)


@pytest.mark.parametrize(
    "word",
    [
        "internationalizationOfThings", "getHttpURLConnectionFactory", "Donaudampfschifffahrtsgesellschaft",
        "antidisestablishmentarianism", "path/to/some/Directory/With/Names", "jQueryAjaxQueueExample", "counterrevolutionaries-12",
    ],
)
def test_spelled_words_are_no_secrets(word):
    assert secrets.spans(f"a word {word}, another".encode()) == []


def test_long_words_of_real_texts_are_left_alone(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() if r.text]
    words = {m.group() for t in texts for m in secrets.RUN.finditer(t.encode()) if not secrets.DIGIT.search(m.group())}
    words = {x for x in words if not secrets.ACCESS.search(x)}
    found = [x for x in words if any(k == 3 for _, _, k in secrets.spans(x))]
    assert len(words) > 20 and len(found) <= 0.05 * len(words)


def test_entropy_spans_against_every_window(spark):
    """Sliding counts against the entropy of each window by itself, over the runs of whole texts."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() if r.text]
    runs = {m.group() for t in texts for m in secrets.RUN.finditer(t.encode())}
    assert len(runs) > 50
    for run in runs:
        want = set()
        for at in range(len(run) - 19):
            window = run[at : at + 20]
            bits = -sum(n / 20 * math.log2(n / 20) for n in Counter(window).values())
            if bits > 3.6 + 1e-9:
                want.update(range(at, at + 20))
        assert {p for a, b in secrets.high_entropy(run, 3.6) for p in range(a, b)} == want
