"""Connected groups of a graph given by its edges, and links found through shared buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkrank.llm.tables import materialised


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges ``a``, ``b``; a component is its smallest node.

    Every node takes the smallest label among its neighbours and then the label of that label, until
    nothing changes; a round is written out, so that lineage stays short. Minima combine before
    each shuffle, and a hub with very many edges is split by the join.
    """
    both = materialised(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = materialised(
        both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node")
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        nearer = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("near"))
        above = labels.select(F.col("node").alias("near"), F.col("label").alias("above"))
        labels = materialised(
            nearer.join(above, "near").select(
                "node", F.least("near", "above").alias("label"), (F.least("near", "above") != F.col("label")).alias("moved")
            )
        )
        if labels.filter("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def linked(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    codes: DataFrame,
    may_hold: Callable[[F.Column, F.Column], F.Column] | None = None,
    cross: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, component) of all nodes that ``members`` (key, node) brings together and verify accepts.

    ``verify`` gets distinct pairs (a, b) and returns those that hold. First every node meets the
    hub of each of its buckets, the member that shares most buckets with others. What hubs connect is
    settled; then the pairs that share a bucket and are still in different components are verified,
    so that components are those of the full graph without listing the pairs of large groups. These
    pairs must pass ``may_hold`` on their ``codes`` (node, code) while they are joined: what is
    clearly unlike leaves the join as no row at all. ``cross`` takes the place of that join: it gets the
    members (key, node, component, code) of such buckets and returns edges that hold and connect them.
    """
    # One shuffle of the narrow member rows serves both the count and the join.
    dealt = members.select("key", "node").repartition("key")
    counted = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialised(dealt.join(counted.hint("merge"), "key"))
    degrees = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = shared.join(degrees, "node").select("key", "node", F.struct("degree", (-F.col("node")).alias("behind")).alias("order"))
    hubs = ranked.groupBy("key").agg((-F.max("order")["behind"]).alias("hub"))
    stars = (
        shared.join(hubs, "key")
        .filter("node <> hub")
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .distinct()
    )
    stars = materialised(stars)
    edges = materialised(verify(stars))
    settled = components(edges)
    placed = shared.join(settled, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    split = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high")
    open_ = materialised(placed.join(split.select("key"), "key").join(codes, "node"))
    if cross is not None:
        return components(edges.unionByName(cross(open_)))
    other = open_.select(
        "key", F.col("node").alias("b"), F.col("component").alias("component_b"), F.col("code").alias("code_b")
    )
    crossing = (
        open_.withColumnRenamed("node", "a")
        .join(other, "key")
        .filter((F.col("component") < F.col("component_b")) & may_hold(F.col("code"), F.col("code_b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    crossing = materialised(crossing.join(stars, ["a", "b"], "left_anti"))
    return components(edges.unionByName(verify(crossing)))
