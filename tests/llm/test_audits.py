"""Audits of sources and filters against brute force, with collisions, ties and odd rows."""

import itertools
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chunkrank.llm import filter_audit, source_audit

SOURCES = "text string, lang string, source string"


def brute_sources(rows, least, top):
    texts = [tuple(x or "" for x in r) for r in rows]
    lowered = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = [(la, s, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(lowered))) for t, la, s in texts]
    out = []
    for lang in {x[0] for x in found}:
        documents = Counter(t for la, _, terms in found if la == lang for t in set(terms))
        kept = {t for t, n in documents.items() if n >= least}
        counts = defaultdict(Counter)
        for la, s, terms in found:
            if la == lang:
                counts[s].update(t for t in terms if t in kept)
        total = sum(counts.values(), Counter())

        def shares(c):
            below = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // below for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        q, own = shares(total), {s: shares(c) for s, c in counts.items()}
        for s, p in own.items():
            pairs = [(o, sum(f(p[t], r[t]) for t in kept)) for o, r in own.items() if o != s]
            terms = [(t, f(p[t], q[t])) for t in kept if counts[s][t] > 0 and p[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


ODD_SOURCES = [
    *[(f"Alpha beta{i % 3} GAMMA the the", "en", f"s{i % 4}") for i in range(40)],
    *[(f"été çà là {'x' * (i % 5)}", "fr", "s0") for i in range(20)],
    *[("漢字 漢字 the", "zh", f"s{i}") for i in range(3)],
    *[("éa éb éc éd ée", "fr", "s1")] * 3,
    (None, "en", None),
    ("", None, "s9"),
    (None, None, None),
    ("the" * 50_000 + " the alpha", "en", "s1"),
    ("[]^_`{}@ 0123", "en", "none"),
]


@pytest.fixture(scope="module")
def odd_sources(spark):
    rows = spark.createDataFrame(ODD_SOURCES, SOURCES)
    return rows.withColumns({c: F.lit("x") for c in ("term", "digest", "split", "n", "value", "rank", "item", "cell")})


def rows_of(df):
    names = ("lang", "source", "part", "item", "value", "rank")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("bits", [64, 5, 0 + 1])
def test_sources_with_and_without_colliding_digests(odd_sources, bits):
    assert rows_of(source_audit.audited(odd_sources, least=3, digest_bits=bits)) == brute_sources(ODD_SOURCES, 3, 10)


def test_sources_when_digests_meet_by_a_shuffle_and_sources_by_blocks(odd_sources, monkeypatch):
    monkeypatch.setattr(source_audit, "SENT_DIGESTS", 1)
    monkeypatch.setattr(source_audit, "BLOCK", 2)
    monkeypatch.setattr(source_audit, "SHARE_ROWS", 3)
    assert rows_of(source_audit.audited(odd_sources, least=2, top=2)) == brute_sources(ODD_SOURCES, 2, 2)


def test_sources_of_an_empty_table(spark):
    assert source_audit.audited(spark.createDataFrame([], SOURCES)).count() == 0


def test_a_language_that_keeps_nothing_still_has_its_pairs(spark):
    rows = [("rare words", "la", "b"), ("other text", "la", "a"), ("", "la", "c")]
    got = rows_of(source_audit.audited(spark.createDataFrame(rows, SOURCES)))
    assert got == brute_sources(rows, 10, 10)
    assert [g[4] for g in got] == [0] * 6


def test_shares_are_exact_beyond_64_bits_of_product(spark):
    n = 8_000_000_000_000_000
    row = spark.createDataFrame([(n - 5, n, 1), (3, n, 7), (0, 0, 1)], "c long, n long, v long")
    got = [r[0] for r in row.select(source_audit.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 2) // (m + 2 * v) for c, m, v in [(n - 5, n, 1), (3, n, 7), (0, 0, 1)]]


# --- filters ---------------------------------------------------------------------------------------


def brute_filters(documents, labels):
    first = {}
    for doc_id, text, _ in documents:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    # A null id is nobody's label.
    good = {d for d, quality, _ in labels if quality == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for doc_id, text, lang in documents:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        failed = ""
        failed += "A" * (len(words) < 200)
        failed += "B" * (100 * len(set(words)) < 50 * len(words))
        failed += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        failed += "D" * bool(re.search("[#$%&*|]", text))
        failed += "E" * (doc_id is not None and first[text] < doc_id)
        parts[lang or ""].append((failed, doc_id in good, doc_id in toxic))
    out = []
    for part, rows in parts.items():
        removed_by = Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[0]]
                fails = sum(name in r[0] for r in rows)
                left = [r for r in left if name not in r[0]]
                removed_by[name] += len(gone)
                alone = sum(r[0] == name for r in rows)
                lost = (sum(r[1] for r in gone), sum(r[2] for r in gone))
                steps.append((part, "".join(order), step, name, len(left), len(gone), fails - len(gone), alone, *lost))
        out += [(*s, removed_by[s[3]]) for s in steps]
    return sorted(out)


LONG = " ".join(f"w{i}" for i in range(300))
DOCUMENTS = [
    (1, LONG, "en"),
    (2, LONG, "en"),
    (2, LONG, "de"),
    (3, LONG + " #", "en"),
    (4, "A B C d", None),
    (5, "one one one one", "en"),
    (6, None, "en"),
    (7, "", "en"),
    (None, "", "en"),
    (None, LONG, "en"),
    (8, ("so " * 900_000) + "X" * 200_000, "en"),
    (9, "Été " * 250, "fr"),
    (0, "one one one one", "fr"),
    (0, "one one one one", "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, 0, 1), (None, 1, 1), (99, 1, 1), (5, None, None)]


@pytest.fixture(scope="module")
def odd_filters(spark):
    docs = spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string")
    docs = docs.withColumns({c: F.lit("x") for c in ("mask", "digest", "part", "good", "toxic", "n", "step", "quality")})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    return docs, labels


def test_filters_against_brute_force(odd_filters):
    names = ("part", "filter_order", "step", "filter", *filter_audit.STEP_COLUMNS)
    got = sorted(tuple(r[n] for n in names) for r in filter_audit.audited(*odd_filters).collect())
    assert got == brute_filters(DOCUMENTS, LABELS)


def test_filters_of_an_empty_table(odd_filters):
    docs, labels = odd_filters
    assert filter_audit.audited(docs.limit(0), labels.limit(0)).count() == 0


def test_many_copies_are_few_rows_before_they_meet(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    counts = filter_audit.histogram(filter_audit.labelled(filter_audit.failures(docs), labels))
    assert sorted((r.mask, r.documents, r.good) for r in counts.collect()) == [(5 - 4, 1, 1), (17, 19_999, 0)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_swaps_lead_through_all_orders(n):
    order = list(range(n))
    seen = {tuple(order)}
    for level in filter_audit.adjacent_swaps(n):
        order[level], order[level + 1] = order[level + 1], order[level]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))


def test_diagram_keeps_its_weight_and_shares_nodes():
    masks = {m: (m + 1, m % 2, m % 3) for m in range(32)} | {7: (0, 0, 0)}
    diagram = filter_audit.Diagram(masks, "ABCDE")
    total = diagram.weights[diagram.root]
    for level in filter_audit.adjacent_swaps(5):
        diagram.swap(level)
        assert diagram.weights[diagram.root] == total
    empty = filter_audit.Diagram({0: (5, 0, 0)}, "ABCDE")
    assert len(empty.weights) == 11
