"""Bucketed snapshots and the change log: what is written, what is read, what a failure leaves."""

from __future__ import annotations

import datetime as dt
import glob
import json
import os
import random

import pytest

from tallyloom.plans import feed
from tallyloom.sources import buckets, change_log
from tallyloom.sources.buckets import BucketedTables
from tallyloom.sources.stored import empty_table

AS_OF = dt.datetime(2024, 6, 1, 12)
LATER = dt.datetime(2024, 7, 1, 12)
N_BUCKETS = 32


def payload(rng, key, title):
    return {
        "business_uid": "biz",
        "account_id": key % 5,
        "title": title,
        "price": rng.randrange(1000) / 100,
        "images": [{"src": f"{key}/{i}", "position": i} for i in range(rng.randrange(3))],
        "categories": rng.sample(["a", "b", "nothing"], rng.randrange(3)),
        "options": [{"name": "size", "value": "S", "position": 0}],
        "variants": [
            {"title": f"v{i}", "options": [{"option": "size", "value": "S"}]} for i in range(rng.randrange(3))
        ],
    }


@pytest.fixture
def parsed(make):
    def build(keys, title, seed):
        rng = random.Random(seed)
        rows = [(key, json.dumps(payload(rng, key, title))) for key in keys]
        return feed.parse_feed(make("feed", rows, "product_id bigint, payload string"))

    return build


@pytest.fixture
def shop(spark, make, parsed):
    """Categories, and some tables of a first delivery of 200 products."""
    tables = {
        "businesses": make("businesses", [(1, "biz")]),
        "categories": make("categories", [(50, 1, "a"), (51, 1, "b")]),
    }
    loaded = feed.load_feed(tables, parsed(range(200), "first", 1), AS_OF)
    first = {name: loaded[name] for name in ("products", "images", "option_variants", "collections")}
    return tables, {**first, **{name: empty_table(spark, name) for name in feed.BUCKET_KEYS if name not in first}}


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def files(root, snapshot):
    """Bucket numbers of the files that a snapshot wrote, per table."""
    found = {}
    for path in glob.glob(f"{root}/{snapshot}/*/bucket=*/*.parquet"):
        table, bucket = path.split(os.sep)[-3:-1]
        found.setdefault(table, set()).add(int(bucket.removeprefix("bucket=")))
    return found


def assert_equal_tables(left, right):
    for name in ("products", "images", "option_variants", "collections"):
        columns = [f"`{column}`" for column in left[name].columns]
        assert rows(left[name]) == rows(right[name].select(columns)), name


def test_replace_writes_the_touched_buckets_only(spark, shop, parsed, tmp_path):
    tables, first = shop
    root = str(tmp_path)
    buckets.write_buckets(first, feed.BUCKET_KEYS, root, "1", N_BUCKETS)
    assert_equal_tables(BucketedTables(spark, root, "1"), first)
    assert len(files(root, "1")["products"]) == N_BUCKETS

    snapshot = BucketedTables(spark, root, "1")
    update = parsed([3, 14, 15, 92, 65, 35, 89, 79, 32, 38, 9_999], "second", 2)  # the last is unknown
    numbers = feed.replace_in_buckets(snapshot, tables, update, LATER, "2")
    written = files(root, "2")
    assert len(numbers) <= 11
    assert all(found <= numbers for found in written.values())

    whole = feed.replace({**tables, "products": first["products"]}, first, update, LATER)
    assert not BucketedTables(spark, root, "2")["variants"].isEmpty()
    assert_equal_tables(BucketedTables(spark, root, "2"), whole)
    assert_equal_tables(BucketedTables(spark, root, "1"), first)  # as it was


def test_delete_leaves_empty_buckets_out(spark, shop, make, tmp_path):
    tables, first = shop
    root = str(tmp_path)
    buckets.write_buckets(first, feed.BUCKET_KEYS, root, "1", 4)
    snapshot = BucketedTables(spark, root, "1")
    gone = first["products"].filter(buckets.bucket_of(first["products"].id, 4) == 2).select("id")
    assert feed.delete_in_buckets(snapshot, gone, "2") == {2}
    left = BucketedTables(spark, root, "2")
    assert files(root, "2") == {} and ("products", 2) not in left.manifest
    assert_equal_tables(left, feed.delete(first, first, gone))
    everything = left["products"].select("id")
    feed.delete_in_buckets(left, everything, "3")
    assert all(BucketedTables(spark, root, "3")[name].isEmpty() for name in feed.BUCKET_KEYS)


def test_a_failed_job_leaves_the_old_state_readable(spark, shop, parsed, tmp_path, monkeypatch):
    tables, first = shop
    root = str(tmp_path)
    buckets.write_buckets(first, feed.BUCKET_KEYS, root, "1", N_BUCKETS)
    snapshot, write, calls = BucketedTables(spark, root, "1"), buckets._write_table, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 4:
            raise OSError("disk is gone")
        write(*args)

    update = parsed(range(10), "second", 2)
    monkeypatch.setattr(buckets, "_write_table", failing)
    with pytest.raises(OSError):
        feed.replace_in_buckets(snapshot, tables, update, LATER, "2")
    monkeypatch.undo()
    with pytest.raises(FileNotFoundError):
        BucketedTables(spark, root, "2")
    assert_equal_tables(BucketedTables(spark, root, "1"), first)
    feed.replace_in_buckets(snapshot, tables, update, LATER, "2-again")
    assert rows(BucketedTables(spark, root, "2-again")["products"].filter("title = 'second'").select("id")) == [
        (key,) for key in range(10)
    ]


def test_rows_of_other_buckets_are_refused(spark, shop, tmp_path):
    _, first = shop
    root = str(tmp_path)
    buckets.write_buckets({"products": first["products"]}, feed.BUCKET_KEYS, root, "1", N_BUCKETS)
    snapshot = BucketedTables(spark, root, "1")
    with pytest.raises(ValueError, match="not to change"):
        snapshot.write_changed({"products": first["products"]}, feed.BUCKET_KEYS, frozenset({1}), "2")


def test_reading_some_buckets_opens_their_files_only(spark, shop, tmp_path):
    _, first = shop
    root = str(tmp_path)
    buckets.write_buckets(first, feed.BUCKET_KEYS, root, "1", N_BUCKETS)
    some = BucketedTables(spark, root, "1").only(frozenset({3, 7}))["images"]
    assert {path.split("bucket=")[1].split("/")[0] for path in some.inputFiles()} <= {"3", "7"}


def test_empty_tables_keep_their_number_of_buckets(spark, tmp_path):
    root = str(tmp_path)
    buckets.write_buckets({"images": empty_table(spark, "images")}, feed.BUCKET_KEYS, root, "1", 8)
    snapshot = BucketedTables(spark, root, "1")
    assert snapshot.buckets == 8 and snapshot["images"].isEmpty()


# --- change log ---------------------------------------------------------------------------------

LOG = "entity_id bigint, action string, old_date date"


def facts(make, *ids):
    return feed.product_changes(make("ids", [(i,) for i in ids], "id bigint"), "update")


def logged(spark, path, **options):
    return [row[0] for row in rows(change_log.read_change_log(spark, path, LOG, **options))]


def test_a_repeated_job_adds_nothing(spark, make, tmp_path):
    path = str(tmp_path / "log")
    assert logged(spark, path) == []
    assert change_log.append_change_log(facts(make, 1, 2), path, "day-1")
    assert not change_log.append_change_log(facts(make, 1, 2), path, "day-1")
    assert change_log.append_change_log(facts(make, 2), path, "day-2")
    assert logged(spark, path) == [1, 2, 2]
    assert logged(spark, path, batches=["day-2", "day-2", "unknown"]) == [2]
    assert change_log.committed_batches(spark, path) == ["day-1", "day-2"]


def test_a_job_killed_before_its_commit(spark, make, tmp_path, monkeypatch):
    path = str(tmp_path / "log")

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(change_log, "create_empty", killed)
    with pytest.raises(KeyboardInterrupt):
        change_log.append_change_log(facts(make, 1, 2), path, "day-1")
    monkeypatch.undo()
    assert logged(spark, path) == []  # its rows lie there, nobody reads them
    assert change_log.append_change_log(facts(make, 1, 2), path, "day-1")
    assert logged(spark, path) == [1, 2]


def test_two_runs_at_once_count_once(spark, make, tmp_path, monkeypatch):
    """The second run has looked for the batch before the first committed it."""
    path = str(tmp_path / "log")
    look = change_log._attempts
    assert change_log.append_change_log(facts(make, 1, 2), path, "day-1")
    monkeypatch.setattr(change_log, "_attempts", lambda *_: {})
    assert change_log.append_change_log(facts(make, 1, 2), path, "day-1")
    monkeypatch.setattr(change_log, "_attempts", look)
    assert logged(spark, path) == [1, 2]


def test_batches_without_rows_and_bad_names(spark, make, tmp_path):
    path = str(tmp_path / "log")
    assert change_log.append_change_log(facts(make), path, "day-1")
    assert not change_log.append_change_log(facts(make, 5), path, "day-1")
    assert logged(spark, path) == []
    for name in ("", "a/b", "a=b", "a b"):
        with pytest.raises(ValueError):
            change_log.append_change_log(facts(make), path, name)
