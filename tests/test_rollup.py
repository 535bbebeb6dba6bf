"""The stored roll-up against the reports planned over the payments."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal as D
from itertools import product

import pytest

from tallyloom.plans import fees, rollup

SCOPES = {"all": [None], "course": [100], "teacher": [2], "lecture": [10, 12]}
SPANS = [None, fees.Month(2024, 1)]


@pytest.fixture
def tables(make):
    """Lecture 12 has no course and no teacher; plan 23 is of an unknown lecture, 24 of none."""
    names = [(20, "Fee", 10, D("5.00")), (21, "Exam", 11, None), (22, "Fee", 12, D("1.50"))]
    payments = [*names, (23, "Fee", 98, D("2.00")), (24, "Other", None, D("3.00"))]
    return {
        "students": make("students", [(i, f"R{i}", f"S{i}", "x") for i in range(5)]),
        "teachers": make("teachers", [(1, "Tom", "t"), (2, "Uma", "u")]),
        "lectures": make("lectures", [(10, "A", 100, 1), (11, "B", 101, 2), (12, "C", None, None)]),
        "payments": make("payments", payments),
        "student__payments": make("student__payments", [(30 + i, 1, 20 + i, "card") for i in range(5)]),
    }


@pytest.fixture
def state(make, tables):
    def build(fee_rows, share_rows):
        at = dt.datetime(2024, 1, 5)
        return {
            **tables,
            "monthly_payments": make("monthly_payments", [(*row, at) for row in fee_rows]),
            "teacher_institute_shares": make("teacher_institute_shares", share_rows),
        }

    return build


def random_state(rng, n):
    fee_rows = {}
    for key in range(n):
        amount = rng.choice([None, D(rng.randrange(100_000)) / 100])
        month = rng.choice([1, 2, 2, None])
        status = rng.choice(["paid", "paid", "paid", "pending"])
        # student 5 and plan 35 do not exist
        fee_rows[key] = (key, rng.randrange(6), rng.randrange(30, 36), amount, status, rng.choice([2024, 2024, 2023]), month)
    share_rows = [
        (rng.randrange(n + 3), rng.choice([1, 2, 2, 7]), *[rng.choice([None, D(rng.randrange(10**6)) / 10_000]) for _ in "ab"])
        for _ in range(2 * n)
    ]
    return fee_rows, share_rows


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def assert_reports_equal(totals, tables):
    for scope, span in product(SCOPES, SPANS):
        for scope_id in SCOPES[scope]:
            ours = rollup.payment_totals(totals, scope, scope_id, span)
            direct = fees.payment_totals(tables, scope, scope_id, span)
            assert rows(ours.select(direct.columns)) == rows(direct), (scope, scope_id, span)


def test_every_report_equals_the_direct_one(state):
    fee_rows, share_rows = random_state(random.Random(1), 60)
    tables = state(fee_rows.values(), share_rows)
    totals = rollup.rollup(rollup.payment_facts(tables)).checkpoint()
    assert_reports_equal(totals, tables)
    for result in (fees.summary, fees.summary_dedup, fees.counts):
        direct = result(fees.payment_totals(tables, "lecture", 10, SPANS[1]))
        assert rows(result(rollup.payment_totals(totals, "lecture", 10, SPANS[1]))) == rows(direct)


def test_merge_of_added_changed_and_cancelled_payments(spark, state, tmp_path):
    rng = random.Random(2)
    fee_rows, share_rows = random_state(rng, 50)
    old = state(fee_rows.values(), share_rows)
    rollup.write_rollup(rollup.rollup(rollup.payment_facts(old)), f"{tmp_path}/first")
    changed = set()
    for key in rng.sample(sorted(fee_rows), 12):
        row = list(fee_rows[key])
        row[rng.choice([3, 4])] = None
        row[4] = rng.choice(["paid", "cancelled"])
        row[6] = rng.choice([1, 2])
        fee_rows[key], _ = tuple(row), changed.add(key)
    fee_rows[70] = (70, 1, 30, D("9.99"), "paid", 2024, 1)  # added, with shares that were there
    share_rows += [(70, 1, D("4.0000"), None), (3, 2, D("1.0000"), D("2.0000"))]
    del fee_rows[5]
    changed |= {70, 3, 5}
    new = state(fee_rows.values(), share_rows)
    ids = spark.createDataFrame([(key,) for key in changed] * 2, "monthly_payment_id bigint")
    stored = rollup.read_rollup(spark, f"{tmp_path}/first")
    rollup.write_rollup(rollup.updated(stored, old, new, ids), f"{tmp_path}/second")
    merged = rollup.read_rollup(spark, f"{tmp_path}/second")
    columns = merged.columns
    assert rows(merged) == rows(rollup.rollup(rollup.payment_facts(new)).select(columns))
    assert_reports_equal(merged, new)


def test_a_sum_of_nothing_is_null_again(spark, state):
    """The only payment with an amount is cancelled: the sum is NULL, not zero; then the group goes."""
    one, two = (1, 1, 30, D("7.00"), "paid", 2024, 1), (2, 1, 30, None, "paid", 2024, 1)
    shares = [(1, 1, D("1.0000"), None), (2, 1, None, None)]
    both, second, none = state([one, two], shares), state([two], shares), state([], shares)
    ids = spark.createDataFrame([(1,), (2,)], "monthly_payment_id bigint")
    left = rollup.updated(rollup.rollup(rollup.payment_facts(both)), both, second, ids)
    (row,) = rollup.payment_totals(left).collect()
    assert (row.student_fee_amount, row.total_teacher_amount, row.no_of_payments) == (None, None, 1)
    assert rollup.updated(left, second, none, ids).collect() == []


def test_reports_read_the_rollup_only(spark, state, tmp_path):
    tables = state([(1, 1, 30, D("7.00"), "paid", 2024, 1)], [(1, 1, D("1.0000"), D("2.0000"))])
    rollup.write_rollup(rollup.rollup(rollup.payment_facts(tables)), f"{tmp_path}/r")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    totals = rollup.payment_totals(rollup.read_rollup(spark, f"{tmp_path}/r"), "course", 100, fees.Month(2024, 1))
    for report in (fees.summary(totals), fees.counts(totals), fees.summary_dedup(totals)):
        plan = report._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        assert len(scans) == 1 and "share_rollup" in scans[0]
        assert "scope#" in scans[0].split("PartitionFilters")[1].split("PushedFilters")[0]
        for part in ("EqualTo(scope_id,100)", "EqualTo(year,2024)", "EqualTo(month,1)"):
            assert part in scans[0]
        assert "Join" not in plan


def test_what_a_rollup_does_not_have(spark, state, tmp_path):
    tables = state([], [])
    empty = rollup.rollup(rollup.payment_facts(tables))
    assert empty.collect() == []
    with pytest.raises(ValueError, match="DateRange"):
        rollup.payment_totals(empty, span=fees.DateRange(dt.date(2024, 1, 1), dt.date(2024, 1, 31)))
    with pytest.raises(ValueError, match="scope"):
        rollup.payment_totals(empty, "course")
    with pytest.raises(FileNotFoundError):
        rollup.read_rollup(spark, str(tmp_path))
