"""Pages by rank against offset."""

from __future__ import annotations

import random

import pytest

from tallyloom.operators import rows as operators
from tallyloom.operators.rows import page, page_by_rank, page_with_total


@pytest.fixture
def sparse(spark):
    """Ids far apart and close together, and rows without one."""
    rng = random.Random(3)
    ids = {rng.randrange(-(10**6), 10**6) for _ in range(150)} | set(range(500, 620)) | {-(2**62), 2**62}
    rows = [(i, f"row {i}") for i in ids] + [(None, "none")]
    return spark.createDataFrame(rows, "id bigint, name string").checkpoint()


def ids(frame):
    return [row.id for row in frame.collect()]


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_equals_offset(sparse, monkeypatch, direction):
    monkeypatch.setattr(operators, "RANK_RANGES", 4)
    monkeypatch.setattr(operators, "RANGE_ROWS", 20)
    known = sparse.filter("id IS NOT NULL")
    for number, size in ((1, 10), (7, 10), (28, 10), (1, 500), (400, 10)):
        assert ids(page_by_rank(sparse, number, size, direction)) == ids(page(known, number, size, direction))


def test_total_and_empty_pages(sparse, spark):
    known = sparse.filter("id IS NOT NULL")
    for number in (2, 1_000):
        ours = page_by_rank(known, number, direction="desc", with_total=True)
        assert ours.collect() == page_with_total(known, number, direction="desc").collect()
    nothing = spark.createDataFrame([], "id bigint, name string")
    assert page_by_rank(nothing).collect() == []
    assert [r.total for r in page_by_rank(nothing, with_total=True).collect()] == [0]
    for bad in ({"number": 0}, {"size": 0}, {"direction": "up"}):
        with pytest.raises(ValueError):
            page_by_rank(sparse, **bad)


def test_a_deep_page_sorts_one_range(spark):
    """Page 100,000 of a million rows: the range that is sorted holds a small part of them."""
    many = spark.range(1_000_000).selectExpr("id * 3 AS id", "'x' AS name")
    low, high, skip, total = operators.located(many, 999_990, 10)
    assert total == 1_000_000 and low <= 3 * 999_990 <= high and (high - low) // 3 < 2_000 and skip < 2_000
    found = page_by_rank(many, 100_000)
    assert ids(found) == [3 * i for i in range(999_990, 1_000_000)]
    assert "TakeOrderedAndProject(limit=" in found._jdf.queryExecution().executedPlan().toString()


def test_repeated_ids_end_the_search(spark, monkeypatch):
    monkeypatch.setattr(operators, "RANGE_ROWS", 5)
    same = spark.createDataFrame([(7,)] * 40 + [(8,)], "id bigint")
    assert ids(page_by_rank(same, 2)) == [7] * 10
    assert ids(page_by_rank(same, 5)) == [8]
