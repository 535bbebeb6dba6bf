"""A layout of stored tables in which ranges of several columns prune.

Every column is replaced by its rank among quantiles of the table, and rows are ordered by the
interleaved bits of the ranks. Rows near each other in all columns so share a row group, and the
Parquet statistics of each column alone skip most of the others.

Parquet statistics of wall-clock columns (``timestamp_ntz``) are not used by Spark's row group filter.
Such a column is stored a second time as microseconds, a plain long whose statistics are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 8
ACCURACY = 4096
MICROS = "__micros"
_MICROS_A_DAY = 86_400_000_000


def micros(column: Column) -> Column:
    epoch = F.to_date(F.lit("1970-01-01")).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, column)


def micros_of_day(day: Column) -> Column:
    return F.unix_date(day).cast("bigint") * _MICROS_A_DAY


def _number(table: DataFrame, name: str) -> Column:
    kind = table.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return micros(F.col(name)).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    raise ValueError(f"no rank for {name}: {kind.simpleString()}")


def _rank(value: Column, bounds: Sequence[float], bits: int) -> Column:
    """How many of the bounds are below the value, by halving; NULL is below all."""
    held = F.array(*[F.lit(float(bound)) for bound in bounds])
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(bits))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(held, at + step - 1) < value, at + step).otherwise(at),
    )


def interleaved(table: DataFrame, columns: Sequence[str], bits: int = BITS) -> Column:
    """The place of a row in the layout. Reads the columns once to find ``2 ** bits - 1`` quantiles of
    each; only these reach the driver, whatever the size of the table."""
    if not 1 <= bits * len(columns) <= 62:
        raise ValueError("bits of all columns must fit into a long")
    shares = [number / (1 << bits) for number in range(1, 1 << bits)]
    found = table.select(
        *[
            F.percentile_approx(_number(table, name), shares, ACCURACY).alias(f"bounds_{place}")
            for place, name in enumerate(columns)
        ]
    ).first()
    place = F.lit(0).cast("bigint")
    for number, name in enumerate(columns):
        if found[number] is None:  # no value at all
            continue
        rank = _rank(_number(table, name), found[number], bits)
        for bit in range(bits):
            moved = F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("bigint"), bit * len(columns) + number)
            place = place.bitwiseOR(moved)
    return place


def write_interleaved(
    table: DataFrame, columns: Sequence[str], path: str, key: str = "id", files: int | None = None,
    row_group_bytes: int | None = None,
) -> None:
    """Write a table in this order by one range exchange. Rows of one place, however many, are spread
    by ``key``. ``files`` is left to the session's shuffle partitions if not given."""
    taken = {name.lower() for name in table.columns}
    place = "place_in_layout"
    while place in taken:
        place = f"_{place}"
    doubled = [f.name for f in table.schema if f.name in columns and isinstance(f.dataType, T.TimestampNTZType)]
    rows = table.withColumns({f"{name}{MICROS}": micros(F.col(name)) for name in doubled})
    rows = rows.withColumn(place, interleaved(table, columns))
    rows = rows.repartitionByRange(files, place, key) if files else rows.repartitionByRange(place, key)
    writer = rows.sortWithinPartitions(place, key).drop(place).write.mode("errorifexists")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)


def read_interleaved(spark: SparkSession, path: str, schema: str, columns: Sequence[str]) -> DataFrame:
    """The table with its doubled wall-clock columns, which ``within`` reads."""
    declared = spark.createDataFrame([], schema).schema
    doubled = [f.name for f in declared if f.name in columns and isinstance(f.dataType, T.TimestampNTZType)]
    more = "".join(f", `{name}{MICROS}` bigint" for name in doubled)
    return spark.read.schema(f"{schema}{more}").parquet(path)


def days_within(table: DataFrame, name: str, first: Column | None, last: Column | None) -> Column:
    """``name`` falls on a day from ``first`` to ``last``; on the doubled column where there is one."""
    if f"{name}{MICROS}" in table.columns:
        value, bound = F.col(f"{name}{MICROS}"), micros_of_day
    else:
        value, bound = F.col(name), lambda day: day.cast("timestamp_ntz")
    condition = F.lit(True)
    if first is not None:
        condition = condition & (value >= bound(first))
    if last is not None:
        condition = condition & (value < bound(F.date_add(last, 1)))
    return condition
