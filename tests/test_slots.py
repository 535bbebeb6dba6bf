"""Clash counts and batch admission against brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tallyloom.operators.slots import clash_counts
from tallyloom.plans import timetable

SLOT_SCHEMA = (
    "id bigint, date date, start_ts timestamp_ntz, end_ts timestamp_ntz, "
    "teacher_id bigint, room_id bigint"
)
DAY = dt.date(2024, 3, 1)


def slot(key, start, end, teacher=1, room=1, day=DAY):
    midnight = dt.datetime.combine(day, dt.time())
    return (
        key,
        day,
        midnight + dt.timedelta(minutes=start),
        midnight + dt.timedelta(minutes=end),
        teacher,
        room,
    )


def random_slots(rng, n, first_id, hot=False):
    slots = []
    for i in range(n):
        begin = rng.randrange(0, 1380) + rng.choice([0, 0, 0.25, 0.5])
        length = rng.choice([15, 30, 45, 60, 61, 240])
        crowded = hot and rng.random() < 0.6
        slots.append(
            slot(
                first_id + i,
                600 + rng.random() if crowded else begin,
                (630 if crowded else begin + length) + rng.random(),
                1 if crowded else rng.randrange(4),
                1 if crowded else rng.randrange(4),
                DAY if crowded else DAY + dt.timedelta(days=rng.randrange(2)),
            )
        )
    return slots


def brute_force(wanted, taken):
    found = {}
    for i, day, start, end, teacher, room in wanted:
        same_day = [t for t in taken if t[1] == day and t[2] < t[3]]
        over = [t for t in same_day if t[2] < end and start < t[3]]
        held = lambda t: (t[2] <= start <= t[3]) + (t[2] <= end <= t[3])
        found[i] = (
            sum(t[4] == teacher for t in over),
            sum(held(t) for t in same_day if t[4] == teacher),
            sum(t[5] == room for t in over),
            sum(held(t) for t in same_day if t[5] == room),
        )
    return found


def counted(spark, wanted, taken):
    result = clash_counts(
        spark.createDataFrame(wanted, SLOT_SCHEMA), spark.createDataFrame(taken, SLOT_SCHEMA)
    )
    return {
        r.id: (r.teacher_clashes, r.teacher_endpoints, r.room_clashes, r.room_endpoints)
        for r in result.collect()
    }


@pytest.mark.parametrize(
    "start, end, overlap, endpoints",
    [
        (540, 600, 0, 1),  # touches the start
        (660, 720, 0, 1),  # touches the end
        (570, 630, 1, 1),  # over the start
        (630, 690, 1, 1),  # over the end
        (615, 645, 1, 2),  # inside
        (540, 720, 1, 0),  # around: only the overlap test sees it
        (600, 660, 1, 2),  # equal
        (300, 360, 0, 0),  # apart
    ],
)
def test_one_taken_slot(spark, start, end, overlap, endpoints):
    found = counted(spark, [slot(1, start, end)], [slot(9, 600, 660)])
    assert found == {1: (overlap, endpoints, overlap, endpoints)}


def test_teacher_room_and_day_are_told_apart(spark):
    taken = [slot(9, 600, 660, teacher=1, room=1)]
    wanted = [
        slot(1, 600, 660, teacher=1, room=2),
        slot(2, 600, 660, teacher=2, room=1),
        slot(3, 600, 660, teacher=1, room=1, day=DAY + dt.timedelta(days=1)),
    ]
    assert counted(spark, wanted, taken) == {
        1: (1, 2, 0, 0),
        2: (0, 0, 1, 2),
        3: (0, 0, 0, 0),
    }


def test_a_slot_without_length_occupies_nothing(spark):
    found = counted(spark, [slot(1, 540, 660)], [slot(9, 600, 600), slot(8, 620, 610)])
    assert found == {1: (0, 0, 0, 0)}


def test_an_unknown_teacher_clashes_with_nobody(spark):
    found = counted(spark, [slot(1, 600, 660, teacher=None)], [slot(9, 600, 660, teacher=None)])
    assert found == {1: (0, 0, 1, 2)}


@pytest.mark.parametrize("hot", [False, True], ids=["even", "crowded room"])
def test_random_slots(spark, hot):
    rng = random.Random(5)
    wanted, taken = random_slots(rng, 120, 0, hot), random_slots(rng, 400, 1000, hot)
    assert counted(spark, wanted, taken) == brute_force(wanted, taken)


# --- batch admission ----------------------------------------------------------------------------


def one_by_one(requests, committed):
    held, outcomes = list(committed), {}
    for request in sorted(requests):
        i, day, start, end, teacher, room = request
        over = [t for t in held if t[1] == day and t[2] < end and start < t[3]]
        if any(t[4] == teacher for t in over):
            outcomes[i] = "teacher"
        elif any(t[5] == room for t in over):
            outcomes[i] = "room"
        else:
            outcomes[i] = "ok"
            held.append(request)
    return outcomes


def batch_tables(make, committed):
    """A lecture per teacher, so that a slot's lecture names its teacher."""
    return {
        "lectures": make("lectures", [(i, f"L{i}", 1, i) for i in range(6)]),
        "teachers": make("teachers", [(i, f"T{i}", f"t{i}@x") for i in range(6)]),
        "rooms": make("rooms", [(i, f"Room {i}", 30) for i in range(6)]),
        "lecture_student": make("lecture_student", [(1, 1)]),
        "daily_schedules": make(
            "daily_schedules", [(i, t, r, d, s, e, "active") for i, d, s, e, t, r in committed]
        ),
    }


def as_requests(make, slots):
    return make("schedule_requests", [(i, t, r, d, s, e) for i, d, s, e, t, r in slots])


@pytest.mark.parametrize("rows_per_date", [20, timetable.ROWS_PER_DATE], ids=["rounds", "in turn"])
@pytest.mark.parametrize("hot", [False, True], ids=["even", "crowded room"])
def test_batch_equals_one_by_one(spark, make, hot, rows_per_date):
    rng = random.Random(11)
    committed = random_slots(rng, 12, 1000)
    requests = random_slots(rng, 150, 0, hot)
    tables = batch_tables(make, committed)
    result = timetable.admit_batch(tables, as_requests(make, requests), rows_per_date)
    assert {r.id: r.outcome for r in result.collect()} == one_by_one(requests, committed)


def test_batch_chain_of_overlaps(make):
    """Each request overlaps the next one: every second one is admitted."""
    chain = [slot(i, 60 * i, 60 * i + 90, teacher=i % 5, room=1) for i in range(8)]
    result = timetable.admit_batch(batch_tables(make, []), as_requests(make, chain))
    outcomes = {r.id: r.outcome for r in result.collect()}
    assert outcomes == {i: "ok" if i % 2 == 0 else "room" for i in range(8)}


@pytest.fixture
def rounds(monkeypatch):
    """How many rounds a batch took."""
    counted = []
    settle = timetable._settle

    def counting(waiting):
        counted.append(1)
        return settle(waiting)

    monkeypatch.setattr(timetable, "_settle", counting)
    return counted


@pytest.mark.parametrize("rows_per_date", [1, timetable.ROWS_PER_DATE])
def test_touching_slots_are_no_rivals(make, rounds, rows_per_date):
    """A day of half-hours of one room and teacher, back to back in id order."""
    day = [slot(i, 30 * i, 30 * i + 30, teacher=1, room=1) for i in range(47)]
    result = timetable.admit_batch(batch_tables(make, []), as_requests(make, day), rows_per_date)
    assert {r.outcome for r in result.collect()} == {"ok"}
    assert len(rounds) <= 3


def test_long_chain_of_overlaps_is_settled_in_turn(make, rounds):
    chain = [slot(i, 7 * i, 7 * i + 10, teacher=i % 5, room=1) for i in range(200)]
    result = timetable.admit_batch(batch_tables(make, []), as_requests(make, chain))
    assert {r.id: r.outcome for r in result.collect()} == one_by_one(chain, [])
    assert not rounds
