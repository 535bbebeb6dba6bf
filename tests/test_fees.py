from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest

from tallyloom.operators.rows import any_equal
from tallyloom.plans import fees


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


@pytest.fixture
def tables(make):
    return {
        "students": make(
            "students", [(1, "R1", "Ann", "a@x"), (2, "R2", "Ben", "b@x")]
        ),
        "teachers": make("teachers", [(1, "Tom", "t1@x"), (2, "Uma", "t2@x")]),
        "lectures": make(
            "lectures", [(10, "Maths", 100, 1), (11, "Physics", 101, 2)]
        ),
        "payments": make(
            "payments",
            [(20, "Maths fee", 10, D("5.00")), (21, "Physics fee", 11, None)],
        ),
        "student__payments": make(
            "student__payments",
            [(30, 1, 20, "monthly"), (31, 2, 21, "card"), (32, 2, 20, "card")],
        ),
        "monthly_payments": make(
            "monthly_payments",
            [
                # two share rows: the fee counts twice
                (1, 1, 30, D("100.00"), "paid", 2024, 1, at("2024-01-05T10:00:00")),
                # no fixed amount
                (2, 2, 31, D("50.00"), "paid", 2024, 2, at("2024-02-29T00:00:00")),
                # after midnight of the last day of a range
                (3, 2, 32, D("70.00"), "paid", 2024, 2, at("2024-02-29T13:00:00")),
                # not paid
                (4, 1, 30, D("999.00"), "pending", 2024, 2, at("2024-02-10T00:00:00")),
                # paid, no share row
                (5, 1, 30, D("888.00"), "paid", 2024, 3, at("2024-03-01T00:00:00")),
                # no month
                (6, 1, 30, D("10.00"), "paid", 2024, None, at("2024-04-01T00:00:00")),
            ],
        ),
        "teacher_institute_shares": make(
            "teacher_institute_shares",
            [
                (1, 1, D("60.0000"), D("10.0000")),
                (1, 2, D("20.0000"), D("10.0000")),
                # the share names teacher 1, the lecture belongs to teacher 2
                (2, 1, D("40.0000"), D("10.0000")),
                (3, 1, D("60.0000"), D("10.0000")),
                (4, 1, D("1.0000"), D("1.0000")),
                (6, 1, D("8.0000"), D("2.0000")),
            ],
        ),
    }


def ids(report):
    return [row.monthly_payment_id for row in report.records.collect()]


def test_records_drop_unpaid_and_shareless_payments_in_date_order(tables):
    assert ids(fees.share_report(tables)) == [1, 1, 2, 3, 6]


def test_month_text_is_null_when_a_part_is_null(tables):
    texts = {
        row.monthly_payment_id: row.month for row in fees.share_report(tables).records.collect()
    }
    assert texts == {1: "2024 1", 2: "2024 2", 3: "2024 2", 6: None}


def test_summary_counts_a_fee_once_per_share_row(tables):
    row = fees.share_report(tables).summary.first()
    assert row.total_teacher_amount == D("188.0000")
    assert row.total_institute_amount == D("42.0000")
    # payment 1 twice, 3 and 6 once, 2 has no fixed amount
    assert row.total_fixed_institute_amount == D("20.00")
    assert row.student_fee_amount == D("330.00")
    assert row.final_total_institute_amount == D("62.0000")


def test_dedup_summary_counts_a_fee_once_per_payment(tables):
    row = fees.summary_dedup(fees.payment_totals(tables)).first()
    assert row.student_fee_amount == D("230.00")
    assert row.total_fixed_institute_amount == D("15.00")
    assert row.total_teacher_amount == D("188.0000")


def test_revenue_is_null_when_one_part_is_null(tables):
    row = fees.share_report(tables, "lecture", 11).summary.first()
    assert row.total_institute_amount == D("10.0000")
    assert row.total_fixed_institute_amount is None
    assert row.final_total_institute_amount is None


def test_empty_report_has_one_null_summary_row_and_no_counts(tables):
    report = fees.share_report(tables, span=fees.Month(1999, 1))
    assert [tuple(row) for row in report.summary.collect()] == [(None,) * 5]
    assert report.counts.collect() == []
    assert report.records.collect() == []


def test_counts_and_percentages(tables):
    counts = fees.share_report(tables).counts
    assert {tuple(r) for r in counts.collect()} == {("Maths fee", 4), ("Physics fee", 1)}
    shares = {r.payment_name: r.percent for r in fees.percentages(counts).collect()}
    assert shares == {"Maths fee": 80.0, "Physics fee": 20.0}


def test_month_span(tables):
    assert ids(fees.share_report(tables, span=fees.Month(2024, 2))) == [2, 3]


def test_date_range_ends_at_midnight_of_a_bare_last_day(tables):
    day = fees.DateRange(dt.date(2024, 1, 5), dt.date(2024, 2, 29))
    assert ids(fees.share_report(tables, span=day)) == [1, 1, 2]
    moment = fees.DateRange(dt.date(2024, 1, 5), at("2024-02-29T13:00:00"))
    assert ids(fees.share_report(tables, span=moment)) == [1, 1, 2, 3]


def test_scopes(tables):
    assert ids(fees.share_report(tables, "course", 100)) == [1, 1, 3, 6]
    assert ids(fees.share_report(tables, "lecture", 11)) == [2]
    # the teacher of the lecture decides, not the teacher of the share
    assert ids(fees.share_report(tables, "teacher", 2)) == [2]
    assert ids(fees.share_report(tables, "teacher", 1)) == [1, 1, 3, 6]


def test_lecture_scopes_partition_the_whole(tables):
    parts = [
        row
        for lecture in (10, 11)
        for row in fees.share_report(tables, "lecture", lecture).records.collect()
    ]
    assert sorted(parts, key=str) == sorted(fees.share_report(tables).records.collect(), key=str)


@pytest.mark.parametrize(
    "arguments", [("course", None), ("all", 3), ("level", 1)], ids=["no id", "id", "unknown"]
)
def test_wrong_scope_arguments(tables, arguments):
    with pytest.raises(ValueError):
        fees.share_report(tables, *arguments)


def test_any_column_search(tables):
    base = fees.share_base(tables)
    assert [r.monthly_payment_id for r in any_equal(base, "Uma").collect()] == [1]
    assert {r.monthly_payment_id for r in any_equal(base, "100.00").collect()} == {1}
    assert any_equal(base, "100").collect() == []


def test_exports(tables):
    report = fees.share_report(tables)
    export = fees.export_records(report.records)
    assert export.columns[:4] == ["STD Reg No.", "STD Name", "Payment Name", "Teacher Name"]
    assert len(export.columns) == 10
    text = fees.export_summary(report.summary).first()[4]
    assert text == "Rs.42.0000 + Rs.20.00 = Rs.62.0000"


def test_a_hot_payment_gives_the_same_totals(spark, make, tables):
    """One payment holds most share rows."""
    many = [(1, 1, D("1.0000"), D("0.5000"))] * 2000 + [(2, 2, D("3.0000"), D("1.0000"))]
    hot = {**tables, "teacher_institute_shares": make("teacher_institute_shares", many)}
    row = fees.share_report(hot).summary.first()
    assert row.total_teacher_amount == D("2003.0000")
    assert row.student_fee_amount == D("200050.00")
    assert row.total_fixed_institute_amount == D("10000.00")
