"""Fee and revenue-share report: four scopes, three time spans, three results."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.fixed_values import (
    RECORD_HEADINGS,
    REVENUE_HEADING,
    SUMMARY_HEADINGS,
)

Tables = Mapping[str, DataFrame]

SCOPES = ("all", "course", "teacher", "lecture")


@dataclass(frozen=True)
class Month:
    year: int
    month: int


@dataclass(frozen=True)
class DateRange:
    """Both bounds belong to the range. A bound without a time of day is its midnight."""

    first: dt.datetime | dt.date
    last: dt.datetime | dt.date


Span = Month | DateRange | None


@dataclass(frozen=True)
class ShareReport:
    """One report; each result is planned only when it is asked for."""

    tables: Tables
    scope: str
    scope_id: int | None
    span: Span

    @property
    def records(self) -> DataFrame:
        return records(share_base(self.tables, self.scope, self.scope_id, self.span))

    @cached_property
    def totals(self) -> DataFrame:
        """The small table below summary and counts; persist it when both are wanted."""
        return payment_totals(self.tables, self.scope, self.scope_id, self.span)

    @property
    def summary(self) -> DataFrame:
        return summary(self.totals)

    @property
    def counts(self) -> DataFrame:
        return counts(self.totals)


def fee_records(tables: Tables, span: Span = None) -> DataFrame:
    """Paid payments of a time span; ``None`` is all time."""
    paid = tables["monthly_payments"].filter(F.col("status") == "paid")
    if span is None:
        return paid
    if isinstance(span, Month):
        return paid.filter(
            (F.col("year") == int(span.year)) & (F.col("month") == int(span.month))
        )
    if isinstance(span, DateRange):
        first, last = (
            F.lit(bound.isoformat()).cast("timestamp_ntz") for bound in (span.first, span.last)
        )
        return paid.filter(F.col("payment_date").between(first, last))
    raise ValueError(f"unknown span: {span!r}")


def check_scope(scope: str, scope_id: int | None) -> None:
    if scope not in SCOPES:
        raise ValueError(f"unknown scope: {scope!r}")
    if (scope == "all") != (scope_id is None):
        raise ValueError("a scope other than 'all' needs its id, and only such a scope")


def payments_in_scope(tables: Tables, scope: str, scope_id: int | None = None) -> DataFrame:
    """Payment plans of a scope.

    A payment counts when its plan belongs to a lecture of the scope, so the scope is decided on
    the small plan table, once, before any payment or share row is touched.
    """
    check_scope(scope, scope_id)
    payments = tables["payments"]
    if scope == "all":
        return payments
    if scope == "lecture":
        return payments.filter(F.col("lecture_id") == scope_id)
    column = {"course": "course_medium_id", "teacher": "teacher_id"}[scope]
    lectures = tables["lectures"].filter(F.col(column) == scope_id)
    return payments.join(
        lectures.select(F.col("id").alias("lecture_id")), "lecture_id", "left_semi"
    )


def _fees(tables: Tables, scope: str, scope_id: int | None, span: Span) -> DataFrame:
    """Paid payments in scope with the mode and name of their plan."""
    plans = (
        tables["student__payments"]
        .select(F.col("id").alias("student_payment_id"), "payment_id", "payment_type")
        .join(
            payments_in_scope(tables, scope, scope_id).select(
                F.col("id").alias("payment_id"), "name", "fixed_institute_amount"
            ),
            "payment_id",
        )
        .select(
            "student_payment_id",
            F.col("payment_type").alias("mode"),
            F.col("name").alias("payment_name"),
            "fixed_institute_amount",
        )
    )
    fees = fee_records(tables, span).withColumnRenamed("id", "monthly_payment_id")
    return fees.join(plans, "student_payment_id")


def share_base(
    tables: Tables, scope: str = "all", scope_id: int | None = None, span: Span = None
) -> DataFrame:
    """One row per share of a paid payment: the joined view below every record listing."""
    students = tables["students"].select(
        F.col("id").alias("student_id"), "registration_no", F.col("name").alias("student_name")
    )
    teachers = tables["teachers"].select(
        F.col("id").alias("teacher_id"), F.col("name").alias("teacher_name")
    )
    return (
        _fees(tables, scope, scope_id, span)
        .join(students, "student_id")
        .join(tables["teacher_institute_shares"], "monthly_payment_id")
        .join(teachers, "teacher_id")
        .select(
            "monthly_payment_id",
            "registration_no",
            "student_name",
            "mode",
            "payment_name",
            "amount",
            "teacher_amount",
            "teacher_name",
            "institute_amount",
            "fixed_institute_amount",
            F.concat(
                F.col("year").cast("string"), F.lit(" "), F.col("month").cast("string")
            ).alias("month"),
            F.col("month").alias("only_month"),
            F.col("year").alias("only_year"),
            F.col("payment_date").alias("date"),
        )
    )


def records(base: DataFrame) -> DataFrame:
    """Report rows by payment date, ties broken so that the order repeats."""
    return base.orderBy("date", "monthly_payment_id", "teacher_name")


def payment_totals(
    tables: Tables, scope: str = "all", scope_id: int | None = None, span: Span = None
) -> DataFrame:
    """One row per payment name with its sums: the small table below summary and counts.

    Names of students and teachers are not needed here, only that they exist. A fee counts once per
    share row, as in the record listing; the ``once`` sums count it once per payment. Without a
    scope and a span every share is wanted, so shares are summed per payment before they are
    shuffled to it. A narrower report joins first: only shares of its own payments are summed.
    """
    shares = tables["teacher_institute_shares"].join(
        tables["teachers"].select(F.col("id").alias("teacher_id")), "teacher_id", "left_semi"
    )
    fees = (
        _fees(tables, scope, scope_id, span)
        .select(
            "monthly_payment_id", "student_id", "payment_name", "amount", "fixed_institute_amount"
        )
        .join(
            tables["students"].select(F.col("id").alias("student_id")), "student_id", "left_semi"
        )
        .drop("student_id")
    )
    sums = [
        F.sum("teacher_amount").alias("teacher_amount"),
        F.sum("institute_amount").alias("institute_amount"),
        F.count(F.lit(1)).alias("n_shares"),
    ]
    if scope == "all" and span is None:
        per_payment = fees.join(
            shares.groupBy("monthly_payment_id").agg(*sums), "monthly_payment_id"
        )
    else:
        joined = fees.join(shares, "monthly_payment_id")
        per_payment = joined.groupBy(*fees.columns).agg(*sums)
    times = F.col("n_shares").cast("decimal(18,0)")
    return (
        per_payment.groupBy("payment_name")
        .agg(
            _money(F.sum("teacher_amount"), 4).alias("total_teacher_amount"),
            _money(F.sum("institute_amount"), 4).alias("total_institute_amount"),
            _money(F.sum(F.col("fixed_institute_amount") * times), 2).alias(
                "total_fixed_institute_amount"
            ),
            _money(F.sum(F.col("amount") * times), 2).alias("student_fee_amount"),
            _money(F.sum("fixed_institute_amount"), 2).alias("once_fixed_institute_amount"),
            _money(F.sum("amount"), 2).alias("once_student_fee_amount"),
            F.sum("n_shares").alias("no_of_payments"),
        )
    )


def _money(total, scale: int):
    return total.cast(f"decimal(38,{scale})")


def summary(totals: DataFrame) -> DataFrame:
    """One row of totals; an empty report gives one row of NULLs."""
    return _summary(totals, "total_fixed_institute_amount", "student_fee_amount")


def summary_dedup(totals: DataFrame) -> DataFrame:
    """The same totals with every fee and fixed amount counted once per payment."""
    return _summary(totals, "once_fixed_institute_amount", "once_student_fee_amount")


def _summary(totals: DataFrame, fixed: str, fee: str) -> DataFrame:
    sums = totals.agg(
        _money(F.sum("total_teacher_amount"), 4).alias("total_teacher_amount"),
        _money(F.sum("total_institute_amount"), 4).alias("total_institute_amount"),
        _money(F.sum(fixed), 2).alias("total_fixed_institute_amount"),
        _money(F.sum(fee), 2).alias("student_fee_amount"),
    )
    revenue = F.col("total_institute_amount") + F.col("total_fixed_institute_amount")
    return sums.withColumn("final_total_institute_amount", _money(revenue, 4))


def counts(totals: DataFrame) -> DataFrame:
    """Share rows per payment name (the column chart)."""
    return totals.select("payment_name", "no_of_payments")


def percentages(name_counts: DataFrame) -> DataFrame:
    """Share of each payment name in all rows (the pie chart)."""
    everything = name_counts.agg(F.sum("no_of_payments").alias("n")).scalar()
    return name_counts.withColumn(
        "percent", F.col("no_of_payments") * F.lit(100.0) / everything
    )


def share_report(
    tables: Tables, scope: str = "all", scope_id: int | None = None, span: Span = None
) -> ShareReport:
    """The report of a scope and a time span, checked at once, read when its results are used."""
    check_scope(scope, scope_id)
    return ShareReport(tables, scope, scope_id, span)


def export_records(report_records: DataFrame) -> DataFrame:
    """Record columns in export order under their headings."""
    return report_records.select(
        *[F.col(name).alias(heading) for name, heading in RECORD_HEADINGS.items()]
    )


def export_summary(report_summary: DataFrame) -> DataFrame:
    """The summary row with the revenue sum spelled out as text."""

    def rupees(name: str):
        return F.concat(F.lit("Rs."), F.col(name).cast("string"))

    revenue = F.concat(
        rupees("total_institute_amount"),
        F.lit(" + "),
        rupees("total_fixed_institute_amount"),
        F.lit(" = "),
        rupees("final_total_institute_amount"),
    )
    columns = [F.col(name).alias(heading) for name, heading in SUMMARY_HEADINGS.items()]
    return report_summary.select(*columns, revenue.alias(REVENUE_HEADING))
