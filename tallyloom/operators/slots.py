"""Clash counts between time slots, without forming pairs of slots.

Two slots of one holder (a room, or a teacher) on one date overlap when each starts before the
other ends. For a wanted slot ``w`` the taken slots that overlap it number

    (taken slots starting before w ends)  -  (taken slots ended when w starts)

because a slot that has ended has also started. Both terms are running counts read off at one
instant, so a clash needs no join of slots with slots: a crowded room costs one row per distinct
instant, not one row per pair.

Running counts are built in two steps so that no task sees a whole crowded holder: counts inside
one minute (a window over at most one minute of distinct instants) and, on top, the totals of the
minutes before (a window over at most the minutes of a date, already summed).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tallyloom.operators.components import EDGES_PER_TASK, connected

# The kinds of holder a slot occupies; the key of each is in the column ``<kind>_id``. Rows name a
# kind by its number here, counted from 1, which is shorter to shuffle and to sort than its name.
KINDS = ("teacher", "room")


def kind_number(kind: str) -> int:
    return KINDS.index(kind) + 1


def _by_holder(kinds: tuple[str, ...]) -> str:
    """Generator text: one row per kind of holder of a slot."""
    pairs = ", ".join(f"{kind_number(kind)}, {kind}_id" for kind in kinds)
    return f"stack({len(kinds)}, {pairs}) AS kind, holder"


def _minute(at: str) -> str:
    """Whole minutes since 1970, straight from the wall clock."""
    return f"(unix_date(CAST({at} AS DATE)) * 1440L + hour({at}) * 60 + minute({at}))"


def _running_counts(kinds: tuple[str, ...]) -> str:
    """Per holder and instant: taken slots started / ended up to it (``_in`` within its minute,
    ``_carried`` from the minutes before) and before it.

    ``minute`` is never null and says so (``coalesce``). Otherwise a null test is put below one of
    the two readers of ``instants`` only, and the two no longer share its shuffles.
    """
    return f"""
    instants AS (
        SELECT kind, holder, date, at, coalesce({_minute('at')}, 0) AS minute,
               sum(starts) AS starts, sum(ends) AS ends
        FROM (
            SELECT t.kind, t.holder, t.date, t.start_ts, t.end_ts, 1 AS weight
            FROM (SELECT date, start_ts, end_ts, kind, holder FROM taken
                  LATERAL VIEW {_by_holder(kinds)}
                  WHERE date BETWEEN (SELECT min(date) FROM wanted)
                                 AND (SELECT max(date) FROM wanted)) t
            LEFT SEMI JOIN asked
              ON t.kind = asked.kind AND t.holder = asked.holder AND t.date = asked.date
            UNION ALL
            SELECT kind, holder, date, start_ts, end_ts, 0 FROM asked)
        LATERAL VIEW stack(2, start_ts, weight, 0, end_ts, 0, weight) AS at, starts, ends
        GROUP BY kind, holder, date, at),
    inside AS (
        SELECT *, sum(starts) OVER so_far AS starts_in, sum(ends) OVER so_far AS ends_in,
               lead(at) OVER (PARTITION BY kind, holder, date, minute ORDER BY at) IS NULL
               AS closes_minute
        FROM instants
        WINDOW so_far AS (PARTITION BY kind, holder, date, minute ORDER BY at
                          ROWS UNBOUNDED PRECEDING)),
    carried AS (
        SELECT kind, holder, date, minute,
               coalesce(sum(starts_in) OVER earlier, 0) AS starts_carried,
               coalesce(sum(ends_in) OVER earlier, 0) AS ends_carried
        FROM inside WHERE closes_minute
        WINDOW earlier AS (PARTITION BY kind, holder, date ORDER BY minute
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    counts AS (
        SELECT kind, holder, date, at, starts_carried + starts_in AS starts_upto,
               starts_carried + starts_in - starts AS starts_before,
               ends_carried + ends_in AS ends_upto,
               ends_carried + ends_in - ends AS ends_before
        FROM inside JOIN carried USING (kind, holder, date, minute))"""


def _clash_sql(kinds: tuple[str, ...]) -> str:
    """Every wanted slot asks at its start and at its end, for each of its holders."""
    holder_columns = ", ".join(f"{kind}_id" for kind in kinds)
    slot = f"id, date, start_ts, end_ts, {holder_columns}"
    sums = []
    for kind in kinds:
        overlap = "if(is_end, starts_before, -ends_upto)"
        for name, value in (("clashes", overlap), ("endpoints", "starts_upto - ends_before")):
            total = f"sum({value}) FILTER (WHERE kind = {kind_number(kind)})"
            sums.append(f"coalesce({total}, 0) AS {kind}_{name}")
    return f"""
    WITH taken AS (SELECT {slot} FROM {{taken_slots}} WHERE start_ts < end_ts),
    wanted AS (SELECT {slot} FROM {{wanted_slots}} WHERE start_ts < end_ts),
    asked AS (
        SELECT kind, holder, date, start_ts, end_ts FROM wanted
        LATERAL VIEW {_by_holder(kinds)} WHERE holder IS NOT NULL),
    {_running_counts(kinds)},
    probes AS (
        SELECT id, kind, holder, date, is_end, at FROM wanted
        LATERAL VIEW {_by_holder(kinds)}
        LATERAL VIEW stack(2, false, start_ts, true, end_ts) AS is_end, at)
    SELECT id, {", ".join(sums)}
    FROM probes JOIN counts USING (kind, holder, date, at)
    GROUP BY id"""


def clash_counts(
    wanted: DataFrame, taken: DataFrame, kinds: tuple[str, ...] = KINDS
) -> DataFrame:
    """One row per wanted slot: ``id`` and, per kind of holder, how many taken slots

    * overlap it (``<kind>_clashes``; touching slots do not overlap),
    * hold its start or its end, both ends included (``<kind>_endpoints``).

    ``wanted`` and ``taken`` carry ``id, date, start_ts, end_ts`` and ``<kind>_id``; ids of
    ``wanted`` are unique. A slot that does not end after it starts occupies nothing.
    """
    return wanted.sparkSession.sql(_clash_sql(kinds), wanted_slots=wanted, taken_slots=taken)


def claims(slots: DataFrame, minutes: int) -> DataFrame:
    """One row per slot, kind of holder and stretch of ``minutes`` that the slot touches; a stretch
    at whose start the slot ends is not touched."""
    last = _minute("(end_ts - INTERVAL '0.000001' SECOND)")
    touched = f"{_minute('start_ts')} div {minutes}, {last} div {minutes}"
    return slots.sparkSession.sql(
        f"""SELECT id, date, kind, holder, stretch, start_ts, end_ts FROM {{slots}}
            LATERAL VIEW {_by_holder(KINDS)}
            LATERAL VIEW explode(sequence({touched})) AS stretch
            WHERE start_ts < end_ts AND holder IS NOT NULL""",
        slots=slots,
    )


class _Held:
    """The disjoint slots that one holder has taken, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def busy(self, start: int, end: int) -> bool:
        place = bisect_left(self.starts, end) - 1
        return place >= 0 and self.ends[place] > start

    def take(self, start: int, end: int) -> None:
        place = bisect_left(self.starts, start)
        self.starts.insert(place, start)
        self.ends.insert(place, end)


def lost_in_turn(slots: pd.DataFrame) -> pd.DataFrame:
    """Slots of one date, one after the other in id order: who finds a holder taken, and which.

    Columns read: id, start_ts, end_ts, teacher_id, room_id, open. A slot that loses nothing takes its
    holders, if it is ``open``; others only look.
    """
    slots = slots.sort_values("id", kind="stable")
    times = [slots[c].to_numpy().astype("datetime64[us]").astype(np.int64).tolist() for c in ("start_ts", "end_ts")]
    holders = [
        [None if pd.isna(holder) else (kind, int(holder)) for holder in slots[f"{kind}_id"]]
        for kind in KINDS
    ]
    taken: dict[tuple, _Held] = {}
    lost: list[tuple[int, str]] = []
    rows = zip(slots["id"].tolist(), *times, *holders, slots["open"].tolist(), strict=True)
    for number, start, end, *own, is_open in rows:
        own = [holder for holder in own if holder is not None]
        busy = [h for h in own if h in taken and taken[h].busy(start, end)]
        if busy:
            lost.append((number, busy[0][0]))
        elif is_open:
            for holder in own:
                taken.setdefault(holder, _Held()).take(start, end)
    return pd.DataFrame(lost, columns=["id", "lost"]).astype({"id": "int64", "lost": "object"})


# --- slots that meet, directly or through others -------------------------------------------------


def interaction_components(
    slots: DataFrame, kinds: tuple[str, ...] = KINDS, edges_per_task: int = EDGES_PER_TASK
) -> DataFrame:
    """``id`` and ``component``: which ids have slots that meet, directly or through others.

    ``slots`` carries ``id, date, start_ts, end_ts`` and ``<kind>_id``; an id may have several. Two
    slots meet when they occupy a holder on a date in minutes that overlap. Slots of a holder and
    date are first summed up to the latest end per minute of start, so the running latest end that
    cuts them into clusters sees at most the minutes of a date, however many slots there are. An id
    without a slot that occupies anything is a component by itself.
    """
    held = f"""
        SELECT id, kind, holder, date, {_minute('start_ts')} AS begin,
               {_minute("(end_ts - INTERVAL '0.000001' SECOND)")} + 1 AS finish
        FROM {{slots}} LATERAL VIEW {_by_holder(kinds)}
        WHERE start_ts < end_ts AND holder IS NOT NULL AND date IS NOT NULL"""
    edges = slots.sparkSession.sql(
        f"""
        WITH held AS ({held}),
        minutes AS (
            SELECT kind, holder, date, begin, max(finish) AS finish, min(id) AS least
            FROM held GROUP BY kind, holder, date, begin),
        opened AS (
            SELECT *, begin >= coalesce(max(finish) OVER (
                       PARTITION BY kind, holder, date ORDER BY begin
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), begin) AS opens
            FROM minutes),
        clusters AS (
            SELECT kind, holder, date, begin, least, max(if(opens, begin, NULL)) OVER (
                       PARTITION BY kind, holder, date ORDER BY begin) AS cluster
            FROM opened),
        labelled AS (
            SELECT kind, holder, date, begin, min(least) OVER (
                       PARTITION BY kind, holder, date, cluster) AS label
            FROM clusters)
        SELECT DISTINCT id AS a, label AS b FROM held JOIN labelled USING (kind, holder, date, begin)
        UNION ALL
        SELECT DISTINCT id, id FROM {{slots}}""",
        slots=slots,
    )
    return connected(edges, edges_per_task).toDF("id", "component")


def _arrow_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of one task in order, a batch at a time; instants as whole microseconds."""

    def column(array: pa.Array) -> list:
        return (array.cast(pa.int64()) if pa.types.is_timestamp(array.type) else array).to_pylist()

    for batch in batches:
        yield from (
            dict(zip(batch.schema.names, row, strict=True))
            for row in zip(*[column(c) for c in batch.columns], strict=True)
        )


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


LOST = pa.schema([("id", pa.int64()), ("lost", pa.string())])


def lost_by_component(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As :func:`lost_in_turn` for rows sorted by component and id: a task holds the slots that one
    component has taken, never its rows."""

    def lost() -> Iterator[tuple]:
        for _, own in groupby(_arrow_rows(batches), key=lambda row: row["component"]):
            taken: dict[tuple, _Held] = {}
            for row in own:
                holders = [(kind, row[f"{kind}_id"]) for kind in KINDS if row[f"{kind}_id"] is not None]
                busy = [h for h in holders if h in taken and taken[h].busy(row["start_ts"], row["end_ts"])]
                if busy:
                    yield row["id"], busy[0][0]
                elif row["open"]:
                    for holder in holders:
                        taken.setdefault(holder, _Held()).take(row["start_ts"], row["end_ts"])

    return _batches(lost(), LOST)


class _Places:
    """The slots one holder has on a date, which may overlap and may be given up again."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def overlapping(self, start: int, end: int) -> int:
        return bisect_left(self.starts, end) - bisect_right(self.ends, start)

    def add(self, start: int, end: int) -> None:
        insort(self.starts, start)
        insort(self.ends, end)

    def remove(self, start: int, end: int) -> None:
        del self.starts[bisect_left(self.starts, start)]
        del self.ends[bisect_left(self.ends, end)]


MOVED = pa.schema([("sequence", pa.int64()), ("lost", pa.string()), ("from_date", pa.date32())])


def moves_by_component(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moves of schedules, one after the other, for rows sorted by component, ``is_change`` and
    ``sequence``.

    Rows that are no change say where a schedule is before the batch. A change is lost to a holder
    that is taken when its turn comes: by a schedule outside of the batch (``<kind>_fixed``) or by
    another one of the batch where it is then. Otherwise the schedule gives up its place and takes
    the new one. A change that is refused already (``is_refused``) does neither. Gives for each change the kind of holder it lost to, if any, and the date on which
    the schedule was before it. A task holds the places of the schedules of one component.
    """

    def spots(row: dict) -> list[tuple]:
        start, end = row["start_ts"], row["end_ts"]
        if start is None or end is None or start >= end or row["date"] is None:
            return []
        return [
            ((kind, row[f"{kind}_id"], row["date"]), start, end) for kind in KINDS if row[f"{kind}_id"] is not None
        ]

    def settled() -> Iterator[tuple]:
        for _, own in groupby(_arrow_rows(batches), key=lambda row: row["component"]):
            places: dict[tuple, _Places] = {}
            at: dict[int, tuple] = {}

            def leave(number: int) -> None:
                for holder, start, end in at[number][1]:
                    places[holder].remove(start, end)

            def take(number: int, row: dict) -> None:
                at[number] = (row["date"], spots(row))
                for holder, start, end in at[number][1]:
                    places.setdefault(holder, _Places()).add(start, end)

            for row in own:
                number = row["id"]
                if not row["is_change"]:
                    take(number, row)
                    continue
                before = at[number]
                if row["is_refused"]:
                    yield row["sequence"], None, before[0]
                    continue
                leave(number)
                lost = None
                for holder, start, end in spots(row):
                    busy = holder in places and places[holder].overlapping(start, end) > 0
                    if busy or row[f"{holder[0]}_fixed"]:
                        lost = holder[0]
                        break
                if lost is None:
                    take(number, row)
                else:
                    for holder, start, end in before[1]:
                        places[holder].add(start, end)
                yield row["sequence"], lost, before[0]

    return _batches(settled(), MOVED)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)
