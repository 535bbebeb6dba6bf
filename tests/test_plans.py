"""Plans over stored tables: filters and columns that reach the scans, joins on keys."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal as D

import pytest

from tallyloom.plans import catalogue, fees, timetable
from tallyloom.sources.schemas import TABLE_SCHEMAS
from tallyloom.sources.sinks import write_snapshot
from tallyloom.sources.stored import StoredTables, empty_table


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    """Stored tables, empty but for the partitioned ones: only their plans are looked at."""
    tables = {name: empty_table(spark, name) for name in TABLE_SCHEMAS}
    at = dt.datetime(2024, 5, 1, 10)
    rows = {
        "daily_schedules": (1, 1, 3, at.date(), at, at + dt.timedelta(hours=1), "active"),
        "monthly_payments": (1, 1, 1, D("1.00"), "paid", 2024, 5, at),
    }
    for name, row in rows.items():
        tables[name] = spark.createDataFrame([row], TABLE_SCHEMAS[name])
    write_snapshot(tables, f"{tmp_path}/snapshot")
    return StoredTables(spark, f"{tmp_path}/snapshot")


def pushed(plan: str, table: str) -> str:
    """Pushed filters of the scan of one table."""
    for line in plan.splitlines():
        if "FileScan" in line and re.search(rf"/{table}\]", line):
            return re.search(r"PushedFilters: \[(.*?)\], ReadSchema", line).group(1)
    raise AssertionError(f"no scan of {table}")


def pruned(plan: str, table: str) -> str:
    """Partition filters of the scan of one table."""
    for line in plan.splitlines():
        if "FileScan" in line and re.search(rf"/{table}\]", line):
            return re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", line).group(1)
    raise AssertionError(f"no scan of {table}")


def full_plan_of(spark, df) -> str:
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return plan_of(df)


def test_filters_reach_the_scans(spark, stored):
    paid = full_plan_of(
        spark, fees.share_base(stored, "lecture", 4, fees.Month(2024, 5))
    )
    assert "EqualTo(status,paid)" in pushed(paid, "monthly_payments")
    for part in (r"year#\d+ = 2024", r"month#\d+ = 5"):
        assert re.search(part, pruned(paid, "monthly_payments"))
    assert "EqualTo(lecture_id,4)" in pushed(paid, "payments")

    found = full_plan_of(
        spark,
        catalogue.list_products(
            stored, {"min_price": 3, "start": "2024-01-01", "account_id": 7, "category": "1,2"}, True
        ),
    )
    for part in ("GreaterThanOrEqual(price,3.00)", "EqualTo(account_id,7)",
                 "EqualTo(action_type,9)", "GreaterThanOrEqual(created_at,2024-01-01T00:00"):
        assert part in pushed(found, "products")
    assert "In(category_id, [1,2])" in pushed(found, "collections")

    day = full_plan_of(spark, timetable.by_room(stored, "2024-05-01", 3))
    assert re.search(r"date#\d+ = 2024-05-01", pruned(day, "daily_schedules"))
    assert timetable.by_room(stored, "2024-05-01", 3).count() == 1


def test_narrow_summary_does_not_sum_all_shares(spark, stored):
    """Shares are summed after the join with the fees of the report, not before."""

    def sums_below_the_fees(df) -> bool:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        per_payment = plan.index("Aggregate [monthly_payment_id")
        return "student_payment_id" not in plan[per_payment:]

    assert sums_below_the_fees(fees.share_report(stored).summary)
    narrow = fees.share_report(stored, "lecture", 4, fees.Month(2024, 5))
    assert not sums_below_the_fees(narrow.summary)


def test_a_move_reads_the_timetable_once_more(spark, stored):
    """The wanted slots are planned once; what remains is the scan of the taken ones."""
    at = dt.datetime(2024, 5, 1, 11)
    change = [(1, 3, at.date(), at, at + dt.timedelta(hours=1))]
    changes = spark.createDataFrame(change, TABLE_SCHEMAS["schedule_changes"])
    moves = timetable.move(stored, changes, dt.date(2024, 1, 1))
    moves.collect()
    plan = plan_of(moves).split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan[^\n]*daily_schedules", plan)) <= 2


def test_snapshot_without_marker_is_refused(spark, tmp_path):
    empty_table(spark, "rooms").write.parquet(f"{tmp_path}/half/rooms")
    with pytest.raises(FileNotFoundError):
        StoredTables(spark, f"{tmp_path}/half")


def test_scopes_are_semi_joins_on_the_plan_table(spark, stored):
    for scope in ("course", "teacher"):
        plan = plan_of(fees.share_base(stored, scope, 1))
        assert plan.count("LeftSemi") == 1


def test_summary_reads_only_what_it_sums(spark, stored):
    plan = plan_of(fees.share_report(stored).counts)
    for line in plan.splitlines():
        if "FileScan" in line and "teacher_institute_shares" in line:
            assert "amount" not in line.split("ReadSchema")[1]


def test_clash_test_joins_on_keys(spark, stored):
    plan = plan_of(timetable.admit(stored, stored["schedule_requests"]))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
