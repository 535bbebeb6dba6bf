"""Fee report queries and the same questions in SQL."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.rows import any_equal, any_equal_typed
from tallyloom.plans import fees, rollup
from tallyloom.registry.ctes import sql_with
from tallyloom.registry.edge import at_edge
from tallyloom.session import ensure_checkpoint_dir, shared_folder
from tallyloom.sources.derived import DerivedTables
from tallyloom.sources.sinks import write_searchable

SCOPE_IDS = {"all": None, "course": 7, "teacher": 10, "lecture": 201}
MONTH = fees.Month(1997, 5)
RANGE = fees.DateRange(dt.date(1996, 3, 1), dt.date(1998, 6, 30))
SPANS = {"": None, "_by_month": MONTH, "_by_date": RANGE}

SPAN_SQL = {
    "": "",
    "_by_month": "AND f.year = 1997 AND f.month = 5",
    "_by_date": "AND f.payment_date >= TIMESTAMP '1996-03-01' "
    "AND f.payment_date <= TIMESTAMP '1998-06-30'",
}

SCOPE_SQL = {
    "all": "",
    "course": "AND EXISTS (SELECT 1 FROM lectures l WHERE l.id = p.lecture_id "
    "AND l.course_medium_id = 7)",
    "teacher": "AND EXISTS (SELECT 1 FROM lectures l WHERE l.id = p.lecture_id "
    "AND l.teacher_id = 10)",
    "lecture": "AND p.lecture_id = 201",
}


def _base_sql(scope: str, span: str) -> str:
    return f"""
        SELECT f.id AS monthly_payment_id, st.registration_no, st.name AS student_name,
               sp.payment_type AS mode, p.name AS payment_name, f.amount, sh.teacher_amount,
               t.name AS teacher_name, sh.institute_amount, p.fixed_institute_amount,
               f.year || ' ' || f.month AS month, f.month AS only_month, f.year AS only_year,
               f.payment_date AS date
        FROM monthly_payments f, students st, student_plans sp, payments p, shares sh, teachers t
        WHERE f.status = 'paid' AND st.id = f.student_id AND sp.id = f.student_payment_id
          AND p.id = sp.payment_id AND sh.monthly_payment_id = f.id AND t.id = sh.teacher_id
          {SPAN_SQL[span]} {SCOPE_SQL[scope]}"""


RECORDS_SQL = """
    SELECT monthly_payment_id, registration_no, student_name, mode, payment_name,
           CAST(amount AS DOUBLE) AS amount, CAST(teacher_amount AS DOUBLE) AS teacher_amount,
           teacher_name, CAST(institute_amount AS DOUBLE) AS institute_amount,
           CAST(fixed_institute_amount AS DOUBLE) AS fixed_institute_amount, month, only_month,
           only_year, strftime(date, '%Y-%m-%d %H:%M:%S') AS date
    FROM base"""

SUMS_SQL = """
    SELECT CAST(sum(teacher_amount) AS DECIMAL(38,4)) AS teacher,
           CAST(sum(institute_amount) AS DECIMAL(38,4)) AS institute,
           CAST(sum(fixed_institute_amount) AS DECIMAL(38,2)) AS fixed,
           CAST(sum(amount) AS DECIMAL(38,2)) AS fee
    FROM base"""

DEDUP_SUMS_SQL = """
    SELECT (SELECT CAST(sum(teacher_amount) AS DECIMAL(38,4)) FROM base) AS teacher,
           (SELECT CAST(sum(institute_amount) AS DECIMAL(38,4)) FROM base) AS institute,
           CAST(sum(fixed_institute_amount) AS DECIMAL(38,2)) AS fixed,
           CAST(sum(amount) AS DECIMAL(38,2)) AS fee
    FROM (SELECT DISTINCT monthly_payment_id, amount, fixed_institute_amount FROM base)"""

SUMMARY_SQL = """
    SELECT CAST(teacher AS DOUBLE) AS total_teacher_amount,
           CAST(institute AS DOUBLE) AS total_institute_amount,
           CAST(fixed AS DOUBLE) AS total_fixed_institute_amount,
           CAST(fee AS DOUBLE) AS student_fee_amount,
           CAST(institute + CAST(fixed AS DECIMAL(38,4)) AS DOUBLE) AS final_total_institute_amount
    FROM sums"""

COUNTS_SQL = "SELECT payment_name, count(*) AS no_of_payments FROM base GROUP BY payment_name"

PERCENT_SQL = """
    SELECT payment_name, count(*) AS no_of_payments,
           count(*) * 100.0::DOUBLE / (SELECT count(*) FROM base) AS percent
    FROM base GROUP BY payment_name"""

EXPORT_SQL = """
    SELECT registration_no AS "STD Reg No.", student_name AS "STD Name",
           payment_name AS "Payment Name", teacher_name AS "Teacher Name",
           CAST(amount AS DOUBLE) AS "Fee Amount",
           CAST(teacher_amount AS DOUBLE) AS "Teacher Share Amount(Rs)",
           CAST(institute_amount AS DOUBLE) AS "Institute Share Amount(Rs)",
           CAST(fixed_institute_amount AS DOUBLE) AS "Fixed Instiute Share Amount(Rs)",
           month AS "Month", strftime(date, '%Y-%m-%d %H:%M:%S') AS "Payment Date"
    FROM base"""

SUMMARY_TEXT_SQL = """
    SELECT CAST(fee AS DOUBLE) AS "Student Fee Amount",
           CAST(teacher AS DOUBLE) AS "Total Teacher Amount",
           CAST(institute AS DOUBLE) AS "Total Institute Share Amount",
           CAST(fixed AS DOUBLE) AS "Total Fixed Institute Amount",
           'Rs.' || CAST(institute AS VARCHAR) || ' + Rs.' || CAST(fixed AS VARCHAR) || ' = Rs.'
           || CAST(CAST(institute + CAST(fixed AS DECIMAL(38,4)) AS DECIMAL(38,4)) AS VARCHAR)
           AS "Total Institute Revenue(Total Institute Amount + Total Fixed Institute Amount)"
    FROM sums"""

SEARCH_VALUE = "Supplier#000000003"

SEARCH_SQL = RECORDS_SQL + """
    WHERE CAST(monthly_payment_id AS VARCHAR) = '{v}' OR registration_no = '{v}'
       OR student_name = '{v}' OR mode = '{v}' OR payment_name = '{v}'
       OR CAST(base.amount AS VARCHAR) = '{v}' OR CAST(base.teacher_amount AS VARCHAR) = '{v}'
       OR teacher_name = '{v}' OR CAST(base.institute_amount AS VARCHAR) = '{v}'
       OR CAST(base.fixed_institute_amount AS VARCHAR) = '{v}' OR month = '{v}'
       OR CAST(only_month AS VARCHAR) = '{v}' OR CAST(only_year AS VARCHAR) = '{v}'
       OR CAST(base.date AS VARCHAR) = '{v}'"""


# A second state of the payments: everything pending is paid, 1994 is cancelled, 1995 costs one more.
LATER_STATUS = """CASE WHEN status = 'pending' THEN 'paid'
    WHEN status = 'paid' AND year = 1994 THEN 'cancelled' ELSE status END"""
LATER_AMOUNT = "CAST(CASE WHEN year = 1995 THEN amount + 1 ELSE amount END AS DECIMAL(18,2))"

LATER_SQL = f"""
    SELECT * REPLACE ({LATER_STATUS} AS status, {LATER_AMOUNT} AS amount)
    FROM monthly_payments"""

FACTS_SQL = """
    SELECT f.id AS payment, p.lecture_id, l.course_medium_id AS course_id,
           l.teacher_id AS lecturer_id, f.year, f.month, p.name AS payment_name, f.amount,
           p.fixed_institute_amount, sh.teacher_amount, sh.institute_amount,
           row_number() OVER (PARTITION BY f.id) = 1 AS once
    FROM {fees} f JOIN students st ON st.id = f.student_id
    JOIN student_plans sp ON sp.id = f.student_payment_id
    JOIN payments p ON p.id = sp.payment_id
    JOIN shares sh ON sh.monthly_payment_id = f.id JOIN teachers t ON t.id = sh.teacher_id
    LEFT JOIN lectures l ON l.id = p.lecture_id
    WHERE f.status = 'paid'"""

ROLLUP_SQL = """
    SELECT scope, coalesce(scope_id, -1) AS scope_id, monthly, coalesce(year, 0) AS year,
           coalesce(month, 0) AS month, payment_name, teacher AS total_teacher_amount,
           institute AS total_institute_amount, fixed AS total_fixed_institute_amount,
           fee AS student_fee_amount, once_fixed AS once_fixed_institute_amount,
           once_fee AS once_student_fee_amount, no_of_payments
    FROM (
        SELECT CASE WHEN grouping(lecture_id) = 0 THEN 'lecture'
                    WHEN grouping(lecturer_id) = 0 THEN 'teacher'
                    WHEN grouping(course_id) = 0 THEN 'course' ELSE 'all' END AS scope,
               CASE WHEN grouping(lecture_id) = 0 THEN lecture_id
                    WHEN grouping(lecturer_id) = 0 THEN lecturer_id
                    WHEN grouping(course_id) = 0 THEN course_id END AS scope_id,
               grouping(year) = 0 AS monthly, year, month, payment_name,
               CAST(CAST(sum(teacher_amount) AS DECIMAL(38,4)) AS DOUBLE) AS teacher,
               CAST(CAST(sum(institute_amount) AS DECIMAL(38,4)) AS DOUBLE) AS institute,
               CAST(CAST(sum(fixed_institute_amount) AS DECIMAL(38,2)) AS DOUBLE) AS fixed,
               CAST(CAST(sum(amount) AS DECIMAL(38,2)) AS DOUBLE) AS fee,
               CAST(CAST(sum(fixed_institute_amount) FILTER (once) AS DECIMAL(38,2)) AS DOUBLE)
                   AS once_fixed,
               CAST(CAST(sum(amount) FILTER (once) AS DECIMAL(38,2)) AS DOUBLE) AS once_fee,
               count(*) AS no_of_payments
        FROM facts
        GROUP BY GROUPING SETS (
            (payment_name), (payment_name, year, month),
            (lecture_id, payment_name), (lecture_id, payment_name, year, month),
            (lecturer_id, payment_name), (lecturer_id, payment_name, year, month),
            (course_id, payment_name), (course_id, payment_name, year, month)))
    WHERE scope = 'all' OR scope_id IS NOT NULL"""

SCOPE_ID_SQL = {"all": "", "course": "AND scope_id = 7", "teacher": "AND scope_id = 10", "lecture": "AND scope_id = 201"}
SPAN_MONTH_SQL = {"": "NOT monthly", "_by_month": "monthly AND year = 1997 AND month = 5"}

REPORTS_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{scope}{span}' AS report,
               CAST(CAST(sum(total_teacher_amount) AS DECIMAL(38,4)) AS DOUBLE) AS total_teacher_amount,
               CAST(CAST(sum(once_student_fee_amount) AS DECIMAL(38,2)) AS DOUBLE) AS once_student_fee_amount,
               CAST(sum(no_of_payments) AS BIGINT) AS no_of_payments, count(*) AS n_names
        FROM rolled WHERE scope = '{scope}' AND {SPAN_MONTH_SQL[span]} {SCOPE_ID_SQL[scope]}"""
    for scope, span in product(SCOPE_IDS, SPAN_MONTH_SQL)
)


def _shown(totals: DataFrame) -> DataFrame:
    return totals.select(
        "scope",
        F.coalesce("scope_id", F.lit(-1).cast("bigint")).alias("scope_id"),
        "monthly",
        F.coalesce("year", F.lit(0)).alias("year"),
        F.coalesce("month", F.lit(0)).alias("month"),
        "payment_name",
        *rollup.MONEY,
        "no_of_payments",
    )


def _rollup(t) -> DataFrame:
    return rollup.rollup(rollup.payment_facts(t))


def _later(t) -> dict:
    """The tables with the second state of the payments."""
    payments = t["monthly_payments"].withColumns(
        {"status": F.expr(LATER_STATUS), "amount": F.expr(LATER_AMOUNT)}
    )
    return {**{name: t[name] for name in t}, "monthly_payments": payments}


def _merged(t) -> DataFrame:
    """The roll-up of the first state, brought to the second by the payments that differ."""
    changed = (
        t["monthly_payments"]
        .exceptAll(_later(t)["monthly_payments"])
        .select(F.col("id").alias("monthly_payment_id"))
    )
    return rollup.updated(_rollup(t), t, _later(t), changed)


def _rollup_reports(t) -> DataFrame:
    """Every all-time and monthly report out of one roll-up."""
    payments = t["monthly_payments"]
    ensure_checkpoint_dir(payments.sparkSession)
    totals = _rollup(t).checkpoint()
    found = []
    for scope, span in product(SCOPE_IDS, SPAN_MONTH_SQL):
        report = rollup.payment_totals(totals, scope, SCOPE_IDS[scope], SPANS[span])
        found.append(
            report.agg(
                F.sum("total_teacher_amount").cast("decimal(38,4)").alias("total_teacher_amount"),
                F.sum("once_student_fee_amount").cast("decimal(38,2)").alias("once_student_fee_amount"),
                F.sum("no_of_payments").alias("no_of_payments"),
                F.count(F.lit(1)).alias("n_names"),
            ).select(F.lit(f"{scope}{span}").alias("report"), "*")
        )
    return reduce(DataFrame.unionByName, found)


def _searched(t) -> DataFrame:
    """The record listing written for searching, and the files searched."""
    base = fees.share_base(t)
    folder = shared_folder(base.sparkSession, "records")
    write_searchable(base, folder)
    return any_equal_typed(base.sparkSession.read.schema(base.schema).parquet(folder), SEARCH_VALUE)


def _report_query(part: str, scope: str, span: str):
    def run(spark, folder):
        report = fees.share_report(
            DerivedTables(spark, folder), scope, SCOPE_IDS[scope], SPANS[span]
        )
        return at_edge(getattr(report, part))

    return run


def _on_all(build):
    def run(spark, folder):
        return at_edge(build(DerivedTables(spark, folder)))

    return run


def queries() -> dict:
    found = {}
    for scope, span in product(SCOPE_IDS, SPANS):
        for part in ("records", "summary", "counts"):
            found[f"share_{part}_{scope}{span}"] = _report_query(part, scope, span)
    found["share_summary_dedup"] = _on_all(
        lambda t: fees.summary_dedup(fees.payment_totals(t))
    )
    found["share_percentages"] = _on_all(
        lambda t: fees.percentages(fees.counts(fees.payment_totals(t)))
    )
    found["share_export"] = _on_all(
        lambda t: fees.export_records(fees.records(fees.share_base(t)))
    )
    found["share_summary_text"] = _on_all(
        lambda t: fees.export_summary(fees.summary(fees.payment_totals(t)))
    )
    found["share_rollup"] = _on_all(lambda t: _shown(_rollup(t)))
    found["share_rollup_merged"] = _on_all(lambda t: _shown(_merged(t)))
    found["share_rollup_reports"] = _on_all(_rollup_reports)
    found["share_any_search"] = _on_all(
        lambda t: any_equal(fees.share_base(t), SEARCH_VALUE)
    )
    found["share_any_search_typed"] = _on_all(_searched)
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for scope, span in product(SCOPE_IDS, SPANS):
        base = _base_sql(scope, span)
        name = f"{scope}{span}"
        found[f"share_records_{name}"] = sql_with(RECORDS_SQL, base=base)
        found[f"share_summary_{name}"] = sql_with(SUMMARY_SQL, base=base, sums=SUMS_SQL)
        found[f"share_counts_{name}"] = sql_with(COUNTS_SQL, base=base)
    base = _base_sql("all", "")
    found["share_summary_dedup"] = sql_with(SUMMARY_SQL, base=base, sums=DEDUP_SUMS_SQL)
    found["share_percentages"] = sql_with(PERCENT_SQL, base=base)
    found["share_export"] = sql_with(EXPORT_SQL, base=base)
    found["share_summary_text"] = sql_with(SUMMARY_TEXT_SQL, base=base, sums=SUMS_SQL)
    facts = FACTS_SQL.format(fees="monthly_payments")
    found["share_rollup"] = sql_with(ROLLUP_SQL, facts=facts)
    found["share_rollup_reports"] = sql_with(REPORTS_SQL, facts=facts, rolled=ROLLUP_SQL)
    found["share_rollup_merged"] = sql_with(ROLLUP_SQL, later=LATER_SQL, facts=FACTS_SQL.format(fees="later"))
    found["share_any_search"] = found["share_any_search_typed"] = sql_with(SEARCH_SQL.format(v=SEARCH_VALUE), base=base)
    return found
