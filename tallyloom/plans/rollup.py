"""A stored roll-up below the fee reports: all-time and monthly totals of every scope, kept up to date
by the payments that change."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans import fees
from tallyloom.plans.fees import Month, Span, check_scope
from tallyloom.sources.sinks import is_complete, mark_complete

Tables = Mapping[str, DataFrame]

KEYS = ["scope", "scope_id", "monthly", "year", "month", "payment_name"]
MONEY = {
    "total_teacher_amount": 4,
    "total_institute_amount": 4,
    "total_fixed_institute_amount": 2,
    "student_fee_amount": 2,
    "once_fixed_institute_amount": 2,
    "once_student_fee_amount": 2,
}
# How many values went into a sum: a sum of none is NULL, whatever was added and taken off before.
FILLED = {
    "total_teacher_amount": "n_teacher",
    "total_institute_amount": "n_institute",
    "total_fixed_institute_amount": "n_fixed",
    "student_fee_amount": "n_fee",
    "once_fixed_institute_amount": "n_fixed",
    "once_student_fee_amount": "n_fee",
}
NUMBERS = ["n_teacher", "n_institute", "n_fixed", "n_fee", "no_of_payments"]

ROLLUP_SCHEMA = (
    "scope string, scope_id bigint, monthly boolean, year int, month int, payment_name string, "
    + ", ".join(f"{name} decimal(38,{scale})" for name, scale in MONEY.items())
    + ", "
    + ", ".join(f"{name} bigint" for name in NUMBERS)
)


def payment_facts(tables: Tables, only: DataFrame | None = None) -> DataFrame:
    """One row per paid payment that has shares: where it counts and its sums. ``only`` names the
    payments wanted (``monthly_payment_id``); without it, all.

    A share counts if its teacher exists, a payment if its student and its plan do. The scopes are
    those of the plan's lecture; a plan without a known lecture counts in the report of all only.
    """
    shares = tables["teacher_institute_shares"].join(
        tables["teachers"].select(F.col("id").alias("teacher_id")), "teacher_id", "left_semi"
    )
    paid = fees.fee_records(tables).withColumnRenamed("id", "monthly_payment_id")
    if only is not None:
        wanted = only.select("monthly_payment_id").distinct()
        shares = shares.join(wanted, "monthly_payment_id", "left_semi")
        paid = paid.join(wanted, "monthly_payment_id", "left_semi")
    per_payment = shares.groupBy("monthly_payment_id").agg(
        F.sum("teacher_amount").alias("teacher_amount"),
        F.sum("institute_amount").alias("institute_amount"),
        F.count("teacher_amount").alias("n_teacher"),
        F.count("institute_amount").alias("n_institute"),
        F.count(F.lit(1)).alias("n_shares"),
    )
    lectures = tables["lectures"].select(
        F.col("id").alias("lecture_id"),
        F.col("course_medium_id").alias("course_id"),
        F.col("teacher_id").alias("lecturer_id"),
    )
    plans = (
        tables["student__payments"]
        .select(F.col("id").alias("student_payment_id"), "payment_id")
        .join(
            tables["payments"].select(
                F.col("id").alias("payment_id"),
                F.col("name").alias("payment_name"),
                "lecture_id",
                "fixed_institute_amount",
            ),
            "payment_id",
        )
        .join(lectures, "lecture_id", "left")
        .drop("payment_id")
    )
    students = tables["students"].select(F.col("id").alias("student_id"))
    return (
        paid.select("monthly_payment_id", "student_id", "student_payment_id", "amount", "year", "month")
        .join(students, "student_id", "left_semi")
        .join(plans, "student_payment_id")
        .join(per_payment, "monthly_payment_id")
        .drop("student_id", "student_payment_id")
    )


def rollup(facts: DataFrame) -> DataFrame:
    """Totals per scope, its id, month or all time, and payment name.

    Facts are first summed up to lecture, month and payment name; the grouping sets multiply that
    small table only.
    """
    times = F.col("n_shares").cast("decimal(18,0)")

    def money(total, name: str):
        return total.cast(f"decimal(38,{MONEY[name]})").alias(name)

    finest = facts.groupBy("lecture_id", "course_id", "lecturer_id", "year", "month", "payment_name").agg(
        money(F.sum("teacher_amount"), "total_teacher_amount"),
        money(F.sum("institute_amount"), "total_institute_amount"),
        money(F.sum(F.col("fixed_institute_amount") * times), "total_fixed_institute_amount"),
        money(F.sum(F.col("amount") * times), "student_fee_amount"),
        money(F.sum("fixed_institute_amount"), "once_fixed_institute_amount"),
        money(F.sum("amount"), "once_student_fee_amount"),
        F.sum("n_teacher").alias("n_teacher"),
        F.sum("n_institute").alias("n_institute"),
        F.count("fixed_institute_amount").alias("n_fixed"),
        F.count("amount").alias("n_fee"),
        F.sum("n_shares").alias("no_of_payments"),
    )
    ids = {"lecture": "lecture_id", "teacher": "lecturer_id", "course": "course_id"}
    sets = ", ".join(
        f"({', '.join([*scope, 'payment_name', *span])})"
        for scope in ([], *[[column] for column in ids.values()])
        for span in ([], ["year", "month"])
    )
    # a known lecture of no course or teacher is in no such scope
    scope = " ".join(f"WHEN grouping({column}) = 0 THEN '{name}'" for name, column in ids.items())
    scope_id = " ".join(f"WHEN grouping({column}) = 0 THEN {column}" for column in ids.values())
    sums = ", ".join(
        [f"CAST(sum({name}) AS DECIMAL(38,{scale})) AS {name}" for name, scale in MONEY.items()]
        + [f"sum({name}) AS {name}" for name in NUMBERS]
    )
    return facts.sparkSession.sql(
        f"""
        SELECT * FROM (
            SELECT CASE {scope} ELSE 'all' END AS scope, CASE {scope_id} END AS scope_id,
                   grouping(year) = 0 AS monthly, year, month, payment_name, {sums}
            FROM {{finest}} GROUP BY GROUPING SETS ({sets}))
        WHERE scope = 'all' OR scope_id IS NOT NULL""",
        finest=finest,
    )


def merge(stored: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The roll-up after some payments changed: ``before`` and ``after`` are the roll-ups of those
    payments alone, as they were and as they are. Groups that no payment is left in are gone."""
    sums = [*MONEY, *NUMBERS]

    def signed(part: DataFrame, sign: int) -> DataFrame:
        return part.select(*KEYS, *[(F.col(name) * sign).cast(part.schema[name].dataType).alias(name) for name in sums])

    parts = stored.select(*KEYS, *sums).unionByName(signed(before, -1)).unionByName(signed(after, 1))
    totals = parts.groupBy(*KEYS).agg(*[F.sum(name).alias(name) for name in sums])
    return totals.filter("no_of_payments > 0").select(
        *KEYS,
        *[
            F.when(F.col(FILLED[name]) > 0, F.col(name)).cast(f"decimal(38,{scale})").alias(name)
            for name, scale in MONEY.items()
        ],
        *NUMBERS,
    )


def updated(stored: DataFrame, old: Tables, new: Tables, changed: DataFrame) -> DataFrame:
    """The stored roll-up of the tables ``old`` brought to ``new``, reading the shares and payments
    of ``changed`` (``monthly_payment_id``: payments added, changed, cancelled or given other shares)
    alone."""
    return merge(stored, rollup(payment_facts(old, changed)), rollup(payment_facts(new, changed)))


def write_rollup(totals: DataFrame, folder: str) -> None:
    """A new folder, by scope and sorted, so that a report reads a few row groups of its scope."""
    in_order = totals.repartition("scope", "monthly").sortWithinPartitions("scope", "monthly", "scope_id", "year", "month")
    in_order.write.mode("errorifexists").partitionBy("scope", "monthly").parquet(f"{folder}/share_rollup")
    mark_complete(totals.sparkSession, folder)


def read_rollup(spark: SparkSession, folder: str) -> DataFrame:
    if not is_complete(spark, folder):
        raise FileNotFoundError(f"no complete roll-up: {folder}")
    return spark.read.schema(ROLLUP_SCHEMA).parquet(f"{folder}/share_rollup")


def payment_totals(totals: DataFrame, scope: str = "all", scope_id: int | None = None, span: Span = None) -> DataFrame:
    """What :func:`tallyloom.plans.fees.payment_totals` gives, out of the roll-up; for all time or a
    month. A range of dates cuts months and needs the payments themselves."""
    check_scope(scope, scope_id)
    found = totals.filter(F.col("scope") == scope)
    if scope_id is not None:
        found = found.filter(F.col("scope_id") == scope_id)
    if span is None:
        found = found.filter(~F.col("monthly"))
    elif isinstance(span, Month):
        found = found.filter(F.col("monthly") & (F.col("year") == span.year) & (F.col("month") == span.month))
    else:
        raise ValueError(f"a roll-up has no totals of {span!r}")
    return found.select("payment_name", *MONEY, "no_of_payments")
