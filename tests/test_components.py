"""Connected components against a plain union-find."""

from __future__ import annotations

import random

import pytest

from tallyloom.operators import components


def roots(spark, edges, **options):
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    found = components.connected(frame, **options).collect()
    assert len({r.node for r in found}) == len(found)
    return {r.node: r.root for r in found}


def wanted(edges):
    least = {node: node for edge in edges for node in edge}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


@pytest.mark.parametrize("edges_per_task", [1_000, 15])
def test_random_graphs(spark, edges_per_task):
    rng = random.Random(3)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(200, 200), (-5, 7), (-5, 7)]
    assert roots(spark, edges, edges_per_task=edges_per_task) == wanted(edges)


def test_no_edges(spark):
    assert roots(spark, []) == {}


@pytest.mark.parametrize("shape", ["chain", "star"])
def test_rounds_do_not_follow_the_length_of_a_chain(spark, monkeypatch, shape):
    rounds = []
    step = components._small_star
    monkeypatch.setattr(components, "_small_star", lambda links: rounds.append(1) or step(links))
    n = 2_000
    nodes = list(range(n))
    random.Random(1).shuffle(nodes)
    edges = [(nodes[i], nodes[i + 1] if shape == "chain" else nodes[0]) for i in range(n - 1)]
    assert set(roots(spark, edges, edges_per_task=250).values()) == {0}
    assert len(rounds) <= 12  # 2,000 nodes
