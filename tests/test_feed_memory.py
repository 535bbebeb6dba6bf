"""What a task of the registered feed queries holds: payloads are sorted behind a shuffle into
partitions of bounded size only, and settled deliveries are not compared again."""

from __future__ import annotations

import json
import os
import re

import pytest
from test_feed import AS_OF, BARE, FULL, deepest, rows, tables  # noqa: F401

from tallyloom.plans import feed
from tallyloom.registry import catalogue_queries

FOLDER = "/root/testdata/sf0.001"

QUERIES = [
    "feed_documents",
    "feed_images",
    "feed_metadata",
    "feed_option_rejects",
    "feed_option_variants",
    "feed_options",
    "feed_products",
    "feed_variants",
    "feed_videos",
    "product_buckets",
    "product_change_log",
    "product_change_log_committed",
    "product_delete_documents",
    "product_delete_images",
    "product_delete_metadata",
    "product_delete_option_variants",
    "product_delete_options",
]

# in sessions of many partitions, too
WITH_MANY_PARTITIONS = [
    "feed_documents",
    "feed_images",
    "feed_metadata",
    "feed_option_rejects",
    "feed_option_variants",
    "feed_options",
    "feed_products",
    "feed_variants",
    "feed_videos",
    "product_buckets",
    "product_change_log",
    "product_change_log_committed",
    "product_delete_documents",
    "product_delete_images",
    "product_delete_metadata",
    "product_delete_option_variants",
    "product_delete_options",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are missing")
@pytest.mark.parametrize("name", QUERIES)
def test_tasks_of_a_query_hold_bounded_payloads(spark, monkeypatch, name):
    parse, count, parsed, counted = feed.parse_feed, feed.repeated_deliveries, [], []
    monkeypatch.setattr(feed, "parse_feed", lambda df: parsed.append(parse(df)) or parsed[-1])
    monkeypatch.setattr(feed, "repeated_deliveries", lambda df: counted.append(df) or count(df))
    found = catalogue_queries.queries()[name](spark, FOLDER)
    found.count()
    assert parsed and not counted
    for plan in map(plan_of, parsed):
        assert "to_json" in deepest(plan) or "StructsToJson" in deepest(plan)
        assert "Sort" not in deepest(plan)
        assert "REBALANCE_PARTITIONS_BY_COL" in deepest(plan)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are missing")
@pytest.mark.parametrize("name", WITH_MANY_PARTITIONS)
def test_scan_tasks_write_payloads_as_they_come(spark, monkeypatch, name):
    """A shuffle into more partitions than the threshold holds and sorts what a task gives it."""
    threshold = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    parse, parsed = feed.parse_feed, []
    monkeypatch.setattr(feed, "parse_feed", lambda df: parsed.append(parse(df)) or parsed[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(2 * threshold))
    try:
        catalogue_queries.queries()[name](spark, FOLDER)
        plans = [plan_of(df) for df in parsed]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plans
    for plan in plans:
        dealt = re.findall(r", (\d+)\), REBALANCE_PARTITIONS_BY_COL", plan)
        assert dealt and all(int(number) <= threshold for number in dealt)


def test_settled_deliveries_are_not_compared_again(make, tables):  # noqa: F811
    """The same rows from half as many passes over the feed, with blank and repeated products."""
    deliveries = [
        (1, 1, json.dumps(FULL)), (1, 2, json.dumps({**FULL, "title": "late"})), (2, None, json.dumps(BARE)),
        (2, None, json.dumps({**BARE, "title": "A"})), (None, 1, json.dumps(BARE)), (3, 1, None), (4, 1, "no json"),
    ]
    delivered = make("feed", deliveries, "product_id bigint, sequence int, payload string")
    compared = feed.load_feed(tables, feed.parse_feed(delivered), AS_OF)
    settled = feed.load_feed(tables, feed.parse_feed(delivered), AS_OF, once=True)
    assert sorted(map(str, rows(settled["products"].fillna(0), "id", "title"))) == [
        "(0, 'Bare')", "(1, 'late')", "(2, 'Bare')",
    ]
    for name in ("products", *feed.CHILD_TABLES):
        passes = [plan_of(t[name]).count("REBALANCE_PARTITIONS_BY_COL") for t in (compared, settled)]
        assert passes == [2, 1]
        assert sorted(map(str, compared[name].collect())) == sorted(map(str, settled[name].collect()))
