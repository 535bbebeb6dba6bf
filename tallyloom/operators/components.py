"""Connected components of an edge table, in a number of rounds that does not follow the length of
chains."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import ensure_checkpoint_dir

# Edges that one task contracts.
EDGES_PER_TASK = 200_000


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task to stars: each node with the smallest node they connect it to."""
    parent: dict[int, int] = {}

    def find(node: int) -> int:
        top = node
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[node] != top:
            parent[node], node = top, parent[node]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            one, two = find(a), find(b)
            parent[max(one, two)] = min(one, two)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], names=["a", "b"]
    )


def _least_neighbour(links: DataFrame) -> DataFrame:
    """``links`` (node, near) with the smallest of a node and its neighbours. The minimum combines
    before it is shuffled; the join back is one that AQE splits at a crowded node."""
    least = links.groupBy("node").agg(F.min("near").alias("least"))
    return links.join(least, "node").withColumn("least", F.least("least", "node"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest one. ``a`` is never below ``b``."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
    )
    linked = _least_neighbour(both.filter("node <> near"))
    return linked.filter("near > node").select(F.col("near").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the smallest one."""
    linked = _least_neighbour(edges.select(F.col("a").alias("node"), F.col("b").alias("near")))
    lower = linked.filter("near <> least").select(F.col("near").alias("a"), F.col("least").alias("b"))
    own = linked.select(F.col("node").alias("a"), F.col("least").alias("b"))
    return lower.unionAll(own).distinct()


def connected(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for edges (a, b) of longs.

    Tasks contract up to ``edges_per_task`` edges each to stars. If that takes one task, it is the
    result; the stars of several tasks are joined up by alternating large-star and small-star
    steps, whose number grows with the logarithm of the nodes. A node without another is an edge
    (a, a); no edges give no rows.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    given = edges.select("a", "b").checkpoint()
    parts = 1 + given.count() // edges_per_task
    stars = given.repartition(parts).mapInArrow(_contract, "a bigint, b bigint").checkpoint()
    if parts > 1:
        alone = stars.select(F.col("a").alias("node"), F.col("b").alias("root")).filter("node = root")
        links, state = stars.filter("a <> b").distinct().checkpoint(), None
        while state != (state := _fingerprint(links)):
            links = _small_star(_large_star(links)).checkpoint()
        linked = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        rooted = alone.select("node").distinct().join(linked.select("node"), "node", "left_anti")
        return linked.unionAll(rooted.select("node", F.col("node").alias("root")))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _fingerprint(links: DataFrame) -> tuple:
    """Equal for equal sets of links; unequal ones differ in it but for a chance of 2^-64."""
    mark = F.xxhash64("a", "b").cast("decimal(20,0)")
    row = links.agg(F.count(F.lit(1)), F.sum(mark), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
    return tuple(row)
