"""Links inside buckets against the plain join of all their pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkrank.llm import bucket_links
from chunkrank.llm.components import components


def member_rows(seed, buckets=12, nodes=60):
    rnd = random.Random(seed)
    elements = {}
    bases = [sorted(rnd.sample(range(-500, 500), 40)) for _ in range(5)]
    for node in range(nodes):
        own = list(rnd.choice(bases))
        for _ in range(rnd.randrange(0, 12)):
            own[rnd.randrange(len(own))] = rnd.randrange(-500, 500)
        elements[node] = own
    component = {n: n if rnd.random() < 0.7 else n // 10 * 10 for n in range(nodes)}
    code = {n: [rnd.getrandbits(62) if rnd.random() < 0.3 else 5, 7, 9, 11] for n in range(nodes)}
    rows = [(key * 1000, n, component[n], code[n]) for key in range(buckets) for n in rnd.sample(range(nodes), rnd.randrange(1, 30))]
    return rows, elements, component, code


def differences(a, b, planes=2):
    words = len(a) // planes
    return sum(bin((a[w] ^ b[w]) | (a[words + w] ^ b[words + w])).count("1") for w in range(words))


def similar(a, b):
    both = len(set(a) & set(b))
    return both >= 0.6 * (len(a) + len(b) - both) - 1e-9


@pytest.mark.parametrize("block", [3, 7, 512])
@pytest.mark.parametrize("seed", [1, 2])
def test_edges_connect_what_all_pairs_connect(spark, monkeypatch, seed, block):
    monkeypatch.setattr(bucket_links, "ELEMENTS", 13)
    rows, elements, component, code = member_rows(seed)
    members = spark.createDataFrame(rows, "key long, node long, component long, code array<bigint>").repartition(3)
    spelled = spark.createDataFrame(list(elements.items()), "node long, shingles array<int>")
    asked = []

    def spell(wanted):
        asked.append(wanted.count())
        return spelled.join(wanted, "node", "left_semi")

    edges = bucket_links.crossing(members, spell, 0.6, 2, 20, block)
    found = {(r.a, r.b) for r in edges.collect()}
    together = {}
    for key, node, _, _ in rows:
        together.setdefault(key, []).append(node)
    want = {
        (min(a, b), max(a, b))
        for nodes in together.values()
        for a in nodes
        for b in nodes
        if component[a] != component[b] and differences(code[a], code[b]) <= 20 and similar(elements[a], elements[b])
    }
    assert found <= want and want
    own = [(n, c) for n, c in component.items() if n != c]

    def classes(pairs):
        table = spark.createDataFrame(sorted(pairs) + own, "a long, b long")
        return {r.node: r.component for r in components(table).collect()}

    assert classes(found) == classes(want)
    if block == 512:
        assert all(sum(1 for e in found if set(e) <= set(nodes)) < 3 * len(nodes) for nodes in together.values())
    assert asked and asked[0] <= len(elements)


def test_nothing_in_common(spark):
    schema = "key long, node long, component long, code array<bigint>"
    rows = [(1, 1, 1, [0, 0, 0, 0]), (1, 2, 1, [0, 0, 0, 0]), (2, 3, 3, [0, 0, 0, 0]), (2, 4, 4, [-1, -1, -1, -1])]
    empty = spark.createDataFrame([], "node long, shingles array<int>")
    for some in (rows, []):
        members = spark.createDataFrame(some, schema)
        assert bucket_links.crossing(members, lambda wanted: empty.join(wanted, "node", "left_semi"), 0.8, 2, 3).count() == 0


def test_a_large_group_of_unlike_members_sends_no_pairs(spark):
    n = 1500
    members = spark.range(n).select(
        F.lit(5).cast("long").alias("key"), F.col("id").alias("node"), F.col("id").alias("component"), F.array(*[F.lit(1).cast("long")] * 4).alias("code")
    )
    spelled = spark.range(n).select(F.col("id").alias("node"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("id") * 100 + i).cast("int")).alias("shingles"))
    placed = bucket_links.in_blocks(members, 512)
    assert placed.count() == 3 * n
    edges = bucket_links.crossing(members, lambda wanted: spelled.join(wanted, "node", "left_semi"), 0.8, 2, 20)
    assert edges.count() == 0


def test_shared_elements_count_distinct_values():
    values = np.array([1, 1, 2, 3, 1, 2, 9, 4], np.int32)
    got = bucket_links.shared_elements(values, np.array([4, 2, 0, 2]))
    assert got.tolist() == [[2, 2, 0, 0], [2, 2, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
