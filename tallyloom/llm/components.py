"""Connected components of a stored edge table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch


def stars(edges: pd.DataFrame) -> pd.DataFrame:
    """Each node of these edges with the smallest node that they connect it to."""
    parent: dict[int, int] = {}

    def find(node: int) -> int:
        top = node
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[node] != top:
            parent[node], node = top, parent[node]
        return top

    for a, b in zip(edges["a"].tolist(), edges["b"].tolist(), strict=True):
        one, two = find(a), find(b)
        parent[max(one, two)] = min(one, two)
    nodes = list(parent)
    return pd.DataFrame({"node": nodes, "root": [find(n) for n in nodes]}, dtype="int64")


def connected_components(
    edges: DataFrame, scratch: Scratch, edges_per_task: int = 200_000
) -> DataFrame:
    """`node` and `root`, the smallest node of its component, for edges (a, b) of longs.

    Edges are dealt to parts of bounded size and every part is contracted to stars. One part is the
    result. The stars of several parts are joined up in rounds: a round gives a node the smallest
    root among its neighbours' and then the root of that root, so long chains shorten by halves.
    Rounds are written to the shared folder; an empty edge table gives an empty result.
    """
    edges = scratch.keep(edges.select("a", "b").distinct())
    parts = -(-edges.count() // edges_per_task)
    part = F.pmod(F.xxhash64("a"), F.lit(max(1, parts)))
    contracted = scratch.keep(
        edges.groupBy(part.alias("part")).applyInPandas(stars, "node bigint, root bigint")
    )
    if parts <= 1:
        return contracted
    both = scratch.keep(
        contracted.select("node", F.col("root").alias("other"))
        .union(contracted.select(F.col("root").alias("node"), F.col("node").alias("other")))
        .distinct()
    )
    roots = scratch.keep(
        both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root"))
    )
    while True:
        near = roots.select(F.col("node").alias("other"), F.col("root").alias("near"))
        offered = both.join(near, "other").groupBy("node").agg(F.min("near").alias("near"))
        hooked = scratch.keep(
            roots.join(offered, "node").select(
                "node", F.least("root", "near").alias("root"), F.col("root").alias("was")
            )
        )
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = scratch.keep(
            hooked.join(up, "root").select("node", F.least("root", "above").alias("root"), "was")
        )
        roots = jumped.select("node", "root")
        if jumped.filter("root <> was").isEmpty():
            return roots
