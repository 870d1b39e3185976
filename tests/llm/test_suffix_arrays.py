"""Byte strings of earlier documents: the operator and its suffix arrays against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkrank.llm import suffix_arrays


def brute(rows, least):
    order = [(suffix_arrays.NULL_ID if i is None else i, (t or "").encode()) for i, t in rows]
    low = {}
    for i, text in order:
        for at in range(len(text) - least + 1):
            window = text[at : at + least]
            low[window] = min(low.get(window, i), i)
    out = []
    for (doc_id, _), (i, text) in zip(rows, order):
        gone = np.zeros(len(text), dtype=bool)
        for at in range(len(text) - least + 1):
            if low[text[at : at + least]] < i:
                gone[at : at + least] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        out.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def cleaned(spark, rows, least, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("batch", "idx", "of", "kept")})
    found = suffix_arrays.cleaned(docs.repartition(parts), least=least, keep_bytes=True)
    return sorted(((r[0], r[1], r[2], r[3], r[4], bytes(r[5])) for r in found.collect()), key=str)


def planted(seed, n=60):
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(20, 120))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(0, 5)):
            part = rnd.choice(shared)
            if rnd.random() < 0.4:
                at = rnd.randrange(len(part))
                part = part[:at] + rnd.choice("xyß漢") + part[at + rnd.randrange(2) :]
            parts += [part, "".join(rnd.choice("pqrst") for _ in range(rnd.randrange(0, 40)))]
        rows.append((rnd.choice([i, i, i, rnd.randrange(n), None]), "".join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "least"), [(1, 50), (2, 20), (3, 7)])
def test_planted_strings(spark, seed, least):
    rows = planted(seed)
    assert cleaned(spark, rows, least) == brute(rows, least)


ODD = [
    (1, None),
    (2, ""),
    (None, "a" * 500),
    (3, "a" * 500),
    (3, "a" * 500),
    (4, "ab" * 300),
    (5, "b" + "ab" * 300),
    (None, None),
    (6, "x" * 49),
    (7, "x" * 49),
    (8, "y" * 50),
    (9, "y" * 50),
    (10, "é" * 25 + "z"),
    (11, "z" + "é" * 25),
]


def test_odd_rows(spark):
    assert cleaned(spark, ODD, 50) == brute(ODD, 50)


def test_empty_table(spark):
    assert cleaned(spark, [], 50) == []


def test_a_very_long_text_and_one_letter_repeated(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, long), (2, "q" + long[1000:300_000]), (3, "k" * 200_000), (4, "k" * 100_000 + "j")]
    found = {r[0]: r[1:4] for r in cleaned(spark, rows, 50)}
    assert found == {1: (400_000, 0, 0), 2: (299_001, 299_000, 1), 3: (200_000, 0, 0), 4: (100_001, 100_000, 1)}


def test_many_copies_and_one_very_common_passage(spark):
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(150))
    rows = [(i, passage if i % 2 else f"{i:060d}" + passage) for i in range(1500)]
    assert cleaned(spark, rows, 50, parts=7) == brute(rows, 50)


@pytest.mark.parametrize("v", [1, 2, 4, 8, 16])
def test_difference_cover(v):
    cover, way = suffix_arrays.difference_cover(v)
    for r in range(v):
        for s in range(v):
            assert (r + way[r, s]) % v in cover and (s + way[r, s]) % v in cover


@pytest.mark.parametrize("block", [5, 40, 1 << 19])
def test_classes_of_a_pool(monkeypatch, block):
    monkeypatch.setattr(suffix_arrays, "BLOCK_SUFFIXES", block)
    rnd = random.Random(block)
    for _ in range(60):
        least = rnd.choice([3, 6, 12, 24, 50])
        letters = "ab"[: rnd.choice([1, 2])]
        base = [rnd.choice(letters) for _ in range(200)]
        contexts = []
        for _ in range(20):
            at = rnd.randrange(150)
            part = base[at : at + least + rnd.randrange(0, 40)]
            if len(part) >= least:
                # Equal ends and a different middle: the case that only ranks decide.
                part[len(part) // 2] = rnd.choice(letters + "xyz")
                contexts.append("".join(part).encode())
        ids = np.array([rnd.randrange(5) for _ in contexts])
        offsets = np.cumsum([0, *map(len, contexts)])
        got = suffix_arrays.covered(np.frombuffer(b"".join(contexts), np.uint8), offsets, ids, least)
        low = {}
        for c, i in zip(contexts, ids):
            for at in range(len(c) - least + 1):
                low[c[at : at + least]] = min(low.get(c[at : at + least], i), i)
        want = [at + least <= len(c) and i > low[c[at : at + least]] for c, i in zip(contexts, ids) for at in range(len(c))]
        assert got.tolist() == want
