"""Small table operators shared by the subjects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.fixed_values import PAGE_SIZE


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key: the lowest by ``order``.

    A minimum over a struct combines on the map side, so a key holding a large part of the rows
    reaches its reducer as one row per map task; a ranking window would sort them all in one task.
    """
    rest = [c for c in df.columns if c not in set(keys) | set(order)]
    lowest = F.min(F.struct(*order, *rest)).alias("lowest")
    found = df.groupBy(*keys).agg(lowest)
    taken = {c: F.col(f"lowest.`{c}`").alias(c) for c in [*order, *rest]}
    return found.select(*[taken.get(c, F.col(f"`{c}`")) for c in df.columns])


def page(
    df: DataFrame,
    number: int = 1,
    size: int = PAGE_SIZE,
    direction: str = "asc",
    after_id: int | None = None,
) -> DataFrame:
    """One page in id order. Give ``after_id``, the last id seen, to reach a deep page without
    sorting what comes before it."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    ordering = id_order(direction)
    if after_id is not None:
        beyond = F.col("id") > after_id if direction.lower() == "asc" else F.col("id") < after_id
        return df.filter(beyond).orderBy(ordering).limit(size)
    return df.orderBy(ordering).offset(size * (number - 1)).limit(size)


def page_with_total(df: DataFrame, number: int = 1, size: int = PAGE_SIZE, **kw) -> DataFrame:
    """A page with the number of all matching rows beside each row.

    An empty page is one row that has the total only, its other columns being NULL.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    found = page(df, number, size, **kw)
    on_page = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    nothing = total.filter(on_page == 0).select(
        *[F.lit(None).cast(field.dataType).alias(field.name) for field in df.schema], "total"
    )
    return found.withColumn("total", total.scalar()).unionByName(nothing)


# Id ranges that one pass counts, and rows of a range that are sorted without looking closer.
RANK_RANGES = 1024
RANGE_ROWS = 100_000


def located(df: DataFrame, first: int, size: int, direction: str = "asc") -> tuple[int, int, int, int] | None:
    """Where the rows ``first`` to ``first + size - 1`` (from 0) in id order lie: lowest and highest
    id of a range that holds them, the rows to skip in it, and the number of all rows. None if there
    is no such row.

    A pass over the ids counts rows per id range; the ranges that hold the rows asked for are cut
    again while they hold more than ``RANGE_ROWS`` beside them. Rows without an id are in no page.
    """
    descending = not _ascending(direction)
    low, high, total = df.agg(F.min("id"), F.max("id"), F.count("id")).first()
    if first >= total:
        return None
    last = min(first + size, total) - 1
    # counted from the lowest id whatever the direction
    begin, end = (total - 1 - last, total - 1 - first) if descending else (first, last)
    rows = total
    while rows > RANGE_ROWS + size and high > low:
        width = -(-(high - low + 1) // RANK_RANGES)
        place = F.expr(f"CAST((CAST(id AS DECIMAL(20,0)) - {low}) DIV {width} AS INT)")
        counted = df.filter(F.col("id").between(low, high)).groupBy(place.alias("place")).count().collect()
        so_far, chosen = 0, []
        for place, count in sorted(map(tuple, counted)):
            if so_far <= end and so_far + count > begin:
                chosen.append((place, so_far, count))
            so_far += count
        narrower = low + chosen[0][0] * width, min(high, low + (chosen[-1][0] + 1) * width - 1)
        if narrower == (low, high):  # a page between rows that lie too far apart
            break
        begin, end = begin - chosen[0][1], end - chosen[0][1]
        (low, high), rows = narrower, sum(count for _, _, count in chosen)
    return low, high, rows - 1 - end if descending else begin, total


def page_by_rank(
    df: DataFrame, number: int = 1, size: int = PAGE_SIZE, direction: str = "asc", with_total: bool = False
) -> DataFrame:
    """As :func:`page`, or :func:`page_with_total`, for pages far from the start: rows are counted,
    and only the id range that holds the page is read and sorted."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    place = located(df, size * (number - 1), size, direction)
    if place is None:
        return page_with_total(df, number, size, direction=direction) if with_total else df.limit(0)
    low, high, skip, total = place
    inside = df.filter(F.col("id").between(low, high))
    found = inside.orderBy(id_order(direction)).offset(skip).limit(size)
    return found.withColumn("total", F.lit(total).cast("bigint")) if with_total else found


def _ascending(direction: str) -> bool:
    id_order(direction)  # refuses other words
    return direction.lower() == "asc"


def id_order(direction: str) -> Column:
    if direction.lower() not in ("asc", "desc"):
        raise ValueError("direction is 'asc' or 'desc'")
    return F.col("id").asc() if direction.lower() == "asc" else F.col("id").desc()


def any_equal(df: DataFrame, value: str) -> DataFrame:
    """Rows in which any column, seen as text, equals ``value``."""
    hit = F.lit(False)
    for name in df.columns:
        hit = hit | F.coalesce(F.col(name).cast("string") == value, F.lit(False))
    return df.filter(hit)


def any_equal_typed(df: DataFrame, value: str) -> DataFrame:
    """As :func:`any_equal`, with the text read once per column type instead of every cell as text.

    A column can only hold the value if the text is how its type writes it ("1.50" is a decimal with
    two places, "01" no number), so what is left are comparisons of plain columns with values, which
    reach file scans with their statistics and bloom filters. NULL equals nothing.
    """
    kinds = {field.dataType.simpleString() for field in df.schema}
    written = df.sparkSession.range(1).select(
        *[_reads_back(value, kind).alias(kind) for kind in sorted(kinds)]
    )
    fitting = {kind for kind, fits in written.first().asDict().items() if fits}
    hit = F.lit(False)
    for field in df.schema:
        kind, column = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind not in fitting:
            continue
        if kind == "string":
            same = column == value
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            # zeros of both signs are equal but written apart; bounds, as the optimiser would put a
            # value known to be equal in the place of the column
            number = F.lit(value).cast(kind)
            same = (column >= number) & (column <= number) & (column.cast("string") == value)
        elif _is_plain(field.dataType):
            same = column == F.lit(value).cast(kind)
        else:
            same = column.cast("string") == value
        hit = hit | same
    return df.filter(hit)


def _is_plain(kind: T.DataType) -> bool:
    """Types of which two equal values are written alike."""
    return isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampNTZType, T.TimestampType))


def _reads_back(value: str, kind: str) -> Column:
    if not _is_plain(T._parse_datatype_string(kind)) and kind not in ("float", "double"):
        return F.lit(True)
    return F.coalesce(F.lit(value).try_cast(kind).cast("string") == value, F.lit(False))


def replace_by_key(old: DataFrame, keys: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Drop the old rows of every key given, add the new rows."""
    return old.join(keys.select(key), key, "left_anti").unionByName(new)


def require_one(df: DataFrame, what: str) -> DataFrame:
    """The frame itself, or an error when it holds no row."""
    if df.isEmpty():
        raise LookupError(f"no such {what}")
    return df
