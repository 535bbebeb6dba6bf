from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tallyloom.llm import bidiagonal, whitening
from tallyloom.llm.queries import op13_embedding_whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, place int, n string, found int"


@pytest.fixture
def embeddings(spark):
    def build(rows, schema=SCHEMA):
        return spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], schema)

    return build


def by_row(frame):
    found = {}
    for row in frame.collect():
        found.setdefault(row.vec_id, []).append(row)
    return {key: sorted(rows, key=lambda r: r.component) for key, rows in found.items()}


def brute_force(vectors, components):
    """Whole numbers of every vector, exact deviations, and the whitening by an eigensolver."""
    xs = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    fit = np.array(sorted(set(xs)), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    mean = np.array([float(s) / n for s in sums])
    centred = fit.astype(float) - mean
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    deviations = [int(((np.array(x, dtype=object) * n - sums) ** 2).sum()) for x in xs]
    whitened = (np.array(xs, dtype=float) - mean) @ (directions / np.sqrt(values))
    return n, deviations, whitened, values / np.trace(centred.T @ centred / n)


def assert_equal_to_brute_force(found, ids, vectors, components=4):
    n, deviations, whitened, explained = brute_force(vectors, components)
    for k in range(components):
        ours = np.array([found[i][k].whitened for i in ids])
        sign = 1 if abs(ours - whitened[:, k]).max() < abs(ours + whitened[:, k]).max() else -1
        assert np.allclose(ours, sign * whitened[:, k], rtol=1e-7, atol=1e-7)
    for i, deviation in zip(ids, deviations, strict=True):
        assert [r.component for r in found[i]] == list(range(1, components + 1))
        assert {(r.n, r.deviation) for r in found[i]} == {(n, deviation)}
        assert np.allclose([r.explained for r in found[i]], explained, rtol=1e-9)
        assert all(0 <= r.identity_error < 1e-9 for r in found[i])


def test_equals_an_eigensolver(embeddings, scratch):
    rnd = np.random.default_rng(3)
    vectors = (rnd.normal(size=(300, 12)) @ rnd.normal(size=(12, 12))).astype(np.float32).tolist()
    vectors += vectors[:50] * 3  # repeated rows: in the fit once, in the result each
    frame = embeddings(list(enumerate(vectors))).repartition(7)
    found = by_row(whitening.whiten(frame, scratch))
    assert_equal_to_brute_force(found, range(len(vectors)), vectors)


def test_unusable_rows_and_other_columns(embeddings, scratch):
    rnd = random.Random(1)
    good = [[rnd.uniform(-1, 1) for _ in range(3)] for _ in range(20)]
    bad = [None, [1.0, None, 2.0], [float("nan")] * 3, [1.0, float("inf"), 0.0], [-float("inf"), 0.0, 0.0]]
    frame = embeddings(list(enumerate(good + bad)) + [(None, good[0])])
    result = whitening.whiten(frame, scratch, components=2)
    assert set(result.columns) == {
        *("vec_id", "x", "place", "found", "component", "n", "deviation", "whitened", "explained", "identity_error")
    }
    found = by_row(result)
    assert set(found) == {None, *range(20)}
    assert [r.whitened for r in found[None]] == [r.whitened for r in found[0]]
    assert_equal_to_brute_force(found, range(20), good, components=2)


@pytest.mark.parametrize("vectors", [[], [None], [[0.5, 0.25]] * 4, [[], []], [[1.0]]])
def test_nothing_to_whiten(embeddings, scratch, vectors):
    assert whitening.whiten(embeddings(list(enumerate(vectors))), scratch).collect() == []


def test_low_rank_and_short_vectors(embeddings, scratch):
    # the third dimension is constant, a missing entry counts as zero
    vectors = [[i / 8, (i * i % 5) / 8] for i in range(10)] + [[1.0], []]
    found = by_row(whitening.whiten(embeddings(list(enumerate(vectors))), scratch))
    padded = [v + [0.0] * (2 - len(v)) for v in vectors]
    assert_equal_to_brute_force(found, range(12), padded, components=2)


def test_equal_variances(embeddings, scratch):
    corners = [[a, b, c] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    found = by_row(whitening.whiten(embeddings(list(enumerate(corners))), scratch))
    whitened = np.array([[r.whitened for r in found[i]] for i in range(8)])
    assert whitened.shape == (8, 3) and np.allclose(whitened.T @ whitened / 8, np.eye(3))


def test_large_entries_stay_exact(embeddings, scratch):
    vectors = [[2.0**e, -(2.0**e), float(e)] for e in range(0, 60, 6)] + [[3e38, 0.0, 0.0]]
    found = by_row(whitening.whiten(embeddings(list(enumerate(vectors))), scratch, components=1))
    whole = [[min(math.floor(256 * c), 2**63 - 1) for c in v] for v in vectors]
    sums = [sum(column) for column in zip(*whole, strict=True)]
    for i, x in enumerate(whole):
        deviation = sum((len(whole) * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        assert found[i][0].deviation == (deviation if deviation < 2**63 else None)


def test_deviations_in_longs_and_beyond(embeddings):
    model = whitening.Whitening(1000, (7, -3), np.ones(1), np.ones((2, 1)), 1.0)
    blocks = [np.array([[5, 6], [-2, 3]]), np.array([[2**30, 1], [2**50, 0]])]
    for block in blocks:
        exact = [(1000 * int(a) - 7) ** 2 + (1000 * int(b) + 3) ** 2 for a, b in block]
        assert whitening._deviations(block, model) == [d if d < 2**63 else None for d in exact]


def test_triangles_are_joined_in_rounds(embeddings, scratch, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_NUMBERS", 20)
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(200, 6)).astype(np.float32).tolist()
    spark = scratch.spark
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = by_row(whitening.whiten(embeddings(list(enumerate(vectors))), scratch))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert_equal_to_brute_force(found, range(200), vectors)


def test_solver_on_small_matrices():
    """Random matrices with many ties and low ranks against numpy's own solver."""
    rnd = np.random.default_rng(0)
    for _ in range(400):
        rows, n = int(rnd.integers(1, 12)), int(rnd.integers(1, 9))
        a = rnd.integers(-2, 3, size=(rows, n)).astype(float)
        square = np.zeros((n, n))
        triangle = np.linalg.qr(a, mode="r")
        square[: len(triangle)] = triangle
        values, directions = bidiagonal.leading(square, 4)
        wanted = np.linalg.eigvalsh(a.T @ a)[::-1]
        assert len(values) == min(4, np.linalg.matrix_rank(a))
        assert np.allclose(values, wanted[: len(values)], rtol=1e-10, atol=1e-12)
        assert np.allclose(directions.T @ a.T @ a @ directions, np.diag(values), atol=1e-7)
        assert np.allclose(directions.T @ directions, np.eye(len(values)), atol=1e-7)


def test_solver_finds_small_values_accurately():
    upper = np.diag([1.0, 1e-3, 1e-6, 1e-9]) + np.diag([1e-2, 1e-5, 1e-8], 1)
    values = bidiagonal.squared_values(np.diag(upper), np.diag(upper, 1))
    # the product of all singular values of a triangle is the product of its diagonal
    assert math.isclose(float(np.prod(np.sqrt(values))), 1e-18, rel_tol=1e-13)


def test_all_given_embeddings(spark):
    folder = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    found = by_row(op13_embedding_whitening(spark, folder))
    assert_equal_to_brute_force(found, [r.vec_id for r in given], [r.embedding for r in given])
