"""Indexed title search and typed any-column search against the plain forms."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal as D
from urllib.parse import quote

import pytest

from tallyloom.operators.rows import any_equal, any_equal_typed
from tallyloom.plans import catalogue, title_index
from tallyloom.sources.sinks import write_searchable


@pytest.fixture
def titles(spark, tmp_path):
    """Random titles with their index, written."""
    rng = random.Random(4)
    words = ["Red", "red bolt", "100%", "%a_b", "Größe", "ΑΣ", "ab", "a", "", "straße", "İx", "日本語の", "🙂🙂x", "aaaa"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 3)))) for i in range(150)] + [(900, None), (901, "aaaaaa")]
    products = spark.createDataFrame(rows, "id bigint, title string").checkpoint()
    folder = str(tmp_path / "index")
    title_index.write_index(title_index.postings(products), folder)
    return products, title_index.read_index(spark, folder)


def ids(frame):
    return sorted(row.id for row in frame.collect())


PATTERNS = ["red", "RED b", "bolt", "100%", "%a_", "größe", "ασ", "ab", "a", "aaaaa", "日本語", "🙂🙂x", "none such", "red%20bolt", "i̇x"]


def test_search_equals_the_scan(titles):
    products, index = titles
    rng = random.Random(5)
    drawn = [row.title for row in products.collect() if row.title]
    patterns = [quote(p) if "%20" not in p else p for p in PATTERNS]
    for _ in range(8):
        title = rng.choice(drawn)
        start = rng.randrange(len(title))
        patterns.append(quote(title[start : start + rng.randint(1, 7)]))
    for pattern in patterns:
        wanted = ids(products.filter(catalogue.title_contains(pattern)))
        assert ids(title_index.search_titles(products, *index, pattern)) == wanted, pattern


def test_only_the_looked_up_pieces_are_read(titles):
    products, index = titles
    plan = title_index.search_titles(products, *index, "red%20bolt")._jdf.queryExecution().executedPlan().toString()
    (scan,) = [line for line in plan.splitlines() if "FileScan" in line and "gram" in line]
    assert "In(gram, [" in scan
    nothing = title_index.search_titles(products, *index, "red%20zzz")
    assert nothing.isEmpty() and "FileScan" not in nothing._jdf.queryExecution().optimizedPlan().toString()


def test_postings_follow_changed_titles(spark, titles):
    products, (index, _) = titles
    changed = spark.createDataFrame([(1, "Brand new"), (901, None), (2_000, "also new")], "id bigint, title string")
    after = products.join(changed, "id", "left_anti").union(changed)
    rows = lambda frame: sorted(tuple(r) for r in frame.select("gram", "id").collect())
    assert rows(title_index.updated(index, changed)) == rows(title_index.postings(after))


CELLS = (
    "name string, n int, big bigint, price decimal(18,2), rate double, day date, at timestamp_ntz, "
    "flag boolean, list array<int>"
)


@pytest.fixture
def cells(spark):
    rows = [
        ("1.50", 1, 150, D("1.50"), 1.5, dt.date(2024, 5, 1), dt.datetime(2024, 5, 1, 10), True, [1]),
        ("01", 10, 1, D("1.00"), 0.0, dt.date(1, 1, 1), dt.datetime(2024, 5, 1), False, []),
        (None, None, None, None, None, None, None, None, None),
        ("true", -1, 2**62, D("-0.50"), -0.0, None, dt.datetime(2024, 5, 1, 10, 0, 0, 500_000), None, [1, 2]),
        ("2024-05-01", 0, 0, D("0.00"), float("nan"), None, None, None, None),
    ]
    return spark.createDataFrame(rows, CELLS).checkpoint()


VALUES = [
    "1.50", "1.5", "01", "1", "1.0", "1.00", "10", "0", "-0", "-0.0", "0.0", "0.00", "+1", " 1", "150", "true", "TRUE",
    "false", "2024-05-01", "2024-05-01 10:00:00", "2024-05-01 10:00:00.5", "2024-05-01 00:00:00", "0001-01-01", "NaN",
    "null", "", "[1]", "[1, 2]", "[]", "4611686018427387904", "99999999999999999999", "1E1", "-0.50", "-1", "2024-5-1",
]


@pytest.mark.parametrize("value", VALUES)
def test_typed_search_equals_the_cast_form(cells, value):
    rows = lambda frame: sorted(str(r) for r in frame.collect())
    assert rows(any_equal_typed(cells, value)) == rows(any_equal(cells, value))


def test_typed_search_reaches_the_files(spark, cells, tmp_path):
    folder = str(tmp_path / "cells")
    write_searchable(cells, folder)
    stored = spark.read.schema(cells.schema).parquet(folder)
    plan = any_equal_typed(stored.select("name", "n", "price"), "1.50")._jdf.queryExecution().executedPlan().toString()
    assert "Or(EqualTo(name,1.50),EqualTo(price,1.50))" in plan.split("PushedFilters")[1]
    assert any_equal_typed(stored, "1.50").count() == any_equal(stored, "1.50").count() == 1
