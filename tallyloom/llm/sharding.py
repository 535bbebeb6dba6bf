"""Sharding by histogram sort: splitters from exact histograms, then one exchange.

Rows are ordered by a hash of the text and, inside equal texts, by a hash of the id. The splitters
between shards are keys of that order. They are found by counting bytes: the key range is cut into
probe intervals, the exact bytes of every interval are summed over all partitions, and only the
intervals in which a splitter must lie are cut again, until so few rows are left around each
splitter that its exact place can be read off. What reaches the driver in a round is bounded by
shards x probes, whatever the size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_END = 1 << 62
MOST_CELLS = 4096


@dataclass(frozen=True)
class Splitter:
    """Rows below (key, minor) belong to lower shards; minor 0 cuts at the edge of a group."""

    key: int
    minor: int = 0


@dataclass
class Interval:
    """Keys low <= key < high, with `before` bytes below them, and the goals that lie inside."""

    low: int
    high: int
    before: int
    rows: int | None = None
    goals: list[int] = field(default_factory=list)


def shard_rows(
    rows: DataFrame,
    shards: int,
    key: str,
    minor: str,
    size: str,
    tolerance: float = 0.02,
    probes: int = 1024,
    leaf_rows: int = 1000,
    cell_rows: int = 1000,
    row: str | None = None,
) -> DataFrame:
    """Adds `shard` (0 to shards - 1, near equal sums of `size`) and `slot` (gapless per shard).

    `key` and `minor` are longs in [0, 2^62), `size` is a positive long; none of them may be null,
    and no other column may be called shard, slot, _cell, _before or _place. Rows of one key stay
    together while their bytes are at most `tolerance` of an even share; a larger group is cut
    between values of `minor`. A group, or a value of `minor` in a larger group, goes to the shard
    in which the middle of its bytes falls, so a shard differs from an even share by no more than
    the tolerance and the size of one row. Rows equal in key and minor stay together; `row`, if
    given, is a long that tells them apart, so that any number of them are numbered by many tasks.
    The rows are read once in each round: give a stored, narrow table. An empty table gives an empty
    result.
    """
    total = rows.agg(F.sum(size)).first()[0] or 0
    # The middle of a unit is (2 * before + bytes) / 2; goal k of n is reached at total * k / n.
    goals = [2 * total * k for k in range(1, shards)] if total else []
    splitters = _find_splitters(rows, shards, total, goals, key, minor, size, tolerance, probes, leaf_rows)
    dealt = rows.withColumn("shard", _shard_of(splitters, F.col(key), F.col(minor)))
    return _with_slots(dealt, key, minor, cell_rows, row)


def _shard_of(splitters: list[Splitter], key: Column, minor: Column) -> Column:
    passed = [
        F.when((key > s.key) | ((key == s.key) & (minor >= s.minor)), 1).otherwise(0)
        for s in splitters
    ]
    return reduce(lambda a, b: a + b, passed, F.lit(0)).cast("int")


def _with_slots(dealt: DataFrame, key: str, minor: str, cell_rows: int, row: str | None) -> DataFrame:
    """Numbers the rows of a shard in cells, so that no task has to hold a whole shard.

    The offsets of the cells are broadcast: at most shards x MOST_CELLS rows.
    """
    largest = dealt.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    cells = min(MOST_CELLS, max(1, -(-largest // cell_rows)))
    spread = F.xxhash64(minor, row) if row else F.col(minor)
    celled = dealt.withColumn("_cell", F.pmod(spread, F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        celled.groupBy("shard", "_cell")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("shard", "_cell", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("shard", "_cell").orderBy(key, minor, *([row] if row else []))
    return (
        celled.withColumn("_place", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "_cell"])
        .withColumn("slot", (F.col("_before") + F.col("_place") - 1).cast("long"))
        .drop("_cell", "_before", "_place")
    )


def _find_splitters(rows, shards, total, goals, key, minor, size, tolerance, probes, leaf_rows):
    found: dict[int, Splitter] = {}
    hot: dict[int, Interval] = {}

    def settle_key(groups, interval):
        for goal in interval.goals:
            found[goal] = Splitter(interval.high)
            for value, before, amount in groups:
                if amount * shards > tolerance * total:
                    if (before + amount) * 2 * shards >= goal:
                        hot.setdefault(value, Interval(0, KEY_END, before)).goals.append(goal)
                        break
                elif (2 * before + amount) * shards >= goal:
                    found[goal] = Splitter(value)
                    break

    everything = Interval(0, KEY_END, 0, goals=goals)
    _search(rows, shards, everything, key, size, probes, leaf_rows, settle_key)
    for value, interval in hot.items():

        def settle_minor(units, interval, value=value):
            for goal in interval.goals:
                reached = (m for m, before, a in units if (2 * before + a) * shards >= goal)
                found[goal] = Splitter(value, next(reached, interval.high))

        inside = rows.filter(F.col(key) == value)
        _search(inside, shards, interval, minor, size, probes, leaf_rows, settle_minor)
    return [found[goal] for goal in goals]


def _search(rows, shards, start, key, size, probes, leaf_rows, settle) -> None:
    """Counts and cuts until `settle` can read the splitters off single keys."""
    open_intervals = [start] if start.goals else []
    while open_intervals:
        leaves, wide = [], []
        for interval in open_intervals:
            small = interval.rows is not None and interval.rows <= leaf_rows
            (leaves if small or interval.high - interval.low == 1 else wide).append(interval)
        if leaves:
            sums = _sums_by_key(rows, key, size, leaves)
            for interval in leaves:
                groups, before = [], interval.before
                for value, amount in sums:
                    if interval.low <= value < interval.high:
                        groups.append((value, before, amount))
                        before += amount
                settle(groups, interval)
        open_intervals = _cut(rows, shards, key, size, wide, probes, settle) if wide else []


def _sums_by_key(rows, key, size, leaves):
    """At most `leaf_rows` keys for each goal reach the driver."""
    inside = reduce(
        lambda a, b: a | b, [(F.col(key) >= i.low) & (F.col(key) < i.high) for i in leaves]
    )
    sums = rows.filter(inside).groupBy(key).agg(F.sum(size))
    return sorted((row[0], row[1]) for row in sums.collect())


def _cut(rows, shards, key, size, wide, probes, settle):
    """One round over all partitions; the probe intervals in which the goals lie."""
    steps = [-(-(i.high - i.low) // (probes * len(i.goals))) for i in wide]
    pieces = [
        f"WHEN `{key}` >= {i.low} AND `{key}` < {i.high} "
        f"THEN named_struct('of', {n}, 'probe', (`{key}` - {i.low}L) div {step}L)"
        for n, (i, step) in enumerate(zip(wide, steps, strict=True))
    ]
    histogram = (
        rows.select(F.expr(f"CASE {' '.join(pieces)} END").alias("at"), F.col(size).alias("size"))
        .filter("at IS NOT NULL")
        .groupBy("at")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select("at.of", "at.probe", "bytes", "rows")
    )
    counted = sorted(tuple(row) for row in histogram.collect())
    cut = []
    for n, (interval, step) in enumerate(zip(wide, steps, strict=True)):
        probed = [row[1:] for row in counted if row[0] == n]
        parts: dict[int, Interval] = {}
        for goal in interval.goals:
            before = interval.before
            for probe, amount, count in probed:
                if (before + amount) * 2 * shards >= goal:
                    low = interval.low + probe * step
                    high = min(low + step, interval.high)
                    parts.setdefault(probe, Interval(low, high, before, count)).goals.append(goal)
                    break
                before += amount
            else:
                settle([], Interval(interval.high, interval.high, before, 0, [goal]))
        cut += parts.values()
    return cut
