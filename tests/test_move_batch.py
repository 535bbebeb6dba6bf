"""Moves that depend on each other, against one after the other in plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import slots
from tallyloom.plans import timetable

DAY = dt.date(2024, 5, 2)
NEXT = dt.date(2024, 5, 3)
CHANGES = (
    "sequence bigint, id bigint, room_id bigint, date date, start_ts timestamp_ntz, end_ts timestamp_ntz"
)


def at(minute, day=DAY):
    return dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=minute)


def schedule(key, lecture, room, start, end, day=DAY, status="active"):
    return (key, lecture, room, day, at(start, day), at(end, day), status)


def change(sequence, key, room, start, end, day=DAY):
    return (sequence, key, room, day, at(start, day), at(end, day))


@pytest.fixture
def tables(make):
    """Lecture n is taught by teacher n // 2; room 9 has no seats."""

    def build(schedules):
        return {
            "lectures": make("lectures", [(i, f"L{i}", 1, i // 2) for i in range(12)]),
            "teachers": make("teachers", [(i, f"T{i}", f"t{i}@x") for i in range(6)]),
            "rooms": make("rooms", [*[(i, f"Room {i}", 30) for i in range(6)], (9, "Closet", 0)]),
            "lecture_student": make("lecture_student", [(1, 1)]),
            "daily_schedules": make("daily_schedules", schedules),
        }

    return build


def decided(spark, tables, schedules, changes, as_of=DAY):
    frame = spark.createDataFrame(changes, CHANGES)
    return timetable.move_batch(tables(schedules), frame, as_of)


def outcomes(moves):
    return {r.sequence: r.outcome for r in moves.collect()}


def one_by_one(schedules, changes, as_of=DAY):
    """Outcome and date before for each change, and the timetable afterwards."""
    place = {s[0]: s for s in schedules}
    done = {s[0] for s in schedules if s[6] == "completed" or s[3] < as_of}
    found = {}
    for sequence, key, room, day, start, end in sorted(changes):
        if key not in place or key in done:
            found[sequence] = ("completed" if key in done else "not_found", place[key][3] if key in place else None)
            continue
        lecture, before = place[key][1], place[key][3]
        over = [
            s for s in place.values()
            if s[0] != key and s[3] == day and s[4] < s[5] and start < end and s[4] < end and start < s[5]
        ]
        if room not in (*range(6), 9):
            outcome = "room_missing"
        elif room == 9 and lecture == 1:
            outcome = "capacity"
        elif lecture not in range(12):
            outcome = "lecture_missing"
        elif any(s[1] in range(12) and s[1] // 2 == lecture // 2 for s in over):
            outcome = "teacher"
        elif any(s[2] == room for s in over):
            outcome = "room"
        else:
            outcome = "ok"
            place[key] = (key, lecture, room, day, start, end, place[key][6])
        found[sequence] = (outcome, before)
    return found, place


def test_a_swap_needs_a_free_place(spark, tables):
    schedules = [schedule(1, 0, 0, 540, 600), schedule(2, 2, 1, 540, 600)]
    straight = [change(1, 1, 1, 540, 600), change(2, 2, 0, 540, 600)]
    # the second finds the first still in its room
    assert outcomes(decided(spark, tables, schedules, straight)) == {1: "room", 2: "room"}
    around = [change(1, 1, 5, 540, 600), change(2, 2, 0, 540, 600), change(3, 1, 1, 540, 600)]
    moves = decided(spark, tables, schedules, around)
    assert outcomes(moves) == {1: "ok", 2: "ok", 3: "ok"}
    after = timetable.apply_moves(tables(schedules)["daily_schedules"], timetable.last_moves(moves))
    assert {r.id: r.room_id for r in after.collect()} == {1: 1, 2: 0}


def test_a_chain_moves_up_in_order_only(spark, tables):
    schedules = [schedule(i, 2 * i, 0, 60 * i, 60 * i + 60) for i in range(5)]
    up = [change(i, i, 0, 60 * i + 60, 60 * i + 120) for i in range(5)]
    assert set(outcomes(decided(spark, tables, schedules, up)).values()) == {"room", "ok"}
    from_the_end = [(4 - c[0], *c[1:]) for c in up]
    assert set(outcomes(decided(spark, tables, schedules, from_the_end)).values()) == {"ok"}


def test_two_to_one_place(spark, tables):
    schedules = [schedule(1, 0, 0, 540, 600), schedule(2, 2, 1, 540, 600)]
    both = [change(5, 2, 3, 700, 760), change(4, 1, 3, 730, 790)]
    assert outcomes(decided(spark, tables, schedules, both)) == {4: "ok", 5: "room"}


def test_moves_of_one_schedule_see_each_other(spark, tables):
    schedules = [schedule(1, 0, 0, 540, 600)]
    moves = decided(
        spark, tables, schedules, [change(1, 1, 0, 540, 600, NEXT), change(2, 1, 0, 570, 630, NEXT), change(3, 1, 9, 0, 60)]
    ).collect()
    assert {r.sequence: (r.outcome, r.old_date) for r in moves} == {
        1: ("ok", DAY), 2: ("ok", NEXT), 3: ("ok", NEXT),
    }


def test_messages_and_log_follow_the_batch(spark, tables):
    schedules = [schedule(1, 0, 0, 540, 600)]
    moves = decided(spark, tables, schedules, [change(1, 1, 2, 540, 600, NEXT), change(2, 1, 0, 600, 660)])
    log = {tuple(r) for r in timetable.change_log(moves).collect()}
    assert log == {(1, "update", DAY), (1, "update", NEXT)}
    assert timetable.messages(moves).count() == 2


def test_without_sequence_ids_give_the_order(spark, tables):
    schedules = [schedule(1, 0, 0, 540, 600), schedule(2, 2, 1, 540, 600)]
    frame = spark.createDataFrame([change(0, 1, 3, 700, 760), change(0, 2, 3, 700, 760)], CHANGES).drop("sequence")
    moves = timetable.move_batch(tables(schedules), frame, DAY)
    assert {r.id: r.outcome for r in moves.collect()} == {1: "ok", 2: "room"}


@pytest.mark.parametrize("sequences", [(1, 1), (1, None)])
def test_sequences_are_unique(spark, tables, sequences):
    changes = [change(s, 1, 0, 0, 60) for s in sequences]
    with pytest.raises(ValueError, match="sequence"):
        decided(spark, tables, [schedule(1, 0, 0, 540, 600)], changes)


def test_no_changes(spark, tables):
    assert decided(spark, tables, [schedule(1, 0, 0, 540, 600)], []).collect() == []


def random_batch(rng, n_schedules, n_changes, crowded):
    """The timetable itself may hold overlaps and slots without length."""
    minute = lambda: rng.randrange(0, 20 if crowded else 60) * 20
    schedules, changes = [], []
    for key in range(n_schedules):
        start = minute()
        schedules.append(
            schedule(
                key, rng.randrange(13), rng.randrange(2 if crowded else 6), start,
                start + rng.choice([-20, 0, 20, 40, 90]), rng.choice([DAY, DAY, NEXT, dt.date(2024, 5, 1)]),
                rng.choice(["active"] * 9 + ["completed"]),
            )
        )
    for sequence in range(n_changes):
        start = minute()
        changes.append(
            change(
                sequence, rng.randrange(n_schedules + 2), rng.choice([*range(2 if crowded else 6), 7, 9]),
                start, start + rng.choice([0, 20, 40, 40]), rng.choice([DAY, NEXT]),
            )
        )
    return schedules, changes


@pytest.mark.parametrize("crowded", [False, True])
def test_random_batches(spark, tables, crowded):
    rng = random.Random(17 + crowded)
    schedules, changes = random_batch(rng, 60, 150, crowded)
    moves = decided(spark, tables, schedules, changes).checkpoint()
    expected, place = one_by_one(schedules, changes)
    assert {r.sequence: (r.outcome, r.old_date) for r in moves.collect()} == expected
    assert {"ok", "room", "teacher"} <= {outcome for outcome, _ in expected.values()}
    after = timetable.apply_moves(tables(schedules)["daily_schedules"], timetable.last_moves(moves))
    assert {r.id: (r.room_id, r.date, r.start_ts) for r in after.collect()} == {
        k: (s[2], s[3], s[4]) for k, s in place.items()
    }


def test_accepted_moves_never_overlap(spark, tables):
    rng = random.Random(23)
    schedules, changes = random_batch(rng, 40, 200, True)
    moves = decided(spark, tables, schedules, changes)
    last = [r for r in timetable.last_moves(moves).collect() if r.start_ts < r.end_ts]
    for a in last:
        for b in last:
            if a.id < b.id and a.date == b.date and a.start_ts < b.end_ts and b.start_ts < a.end_ts:
                assert a.room_id != b.room_id and a.teacher_id != b.teacher_id


def test_moves_that_do_not_meet_are_settled_apart(spark):
    """A hundred rooms with a chain each, and touching slots, are a component each."""
    rows = [(100 * room + i, DAY, at(50 * i), at(50 * i + 60), None, room) for room in range(100) for i in range(5)]
    rows += [(-1 - i, DAY, at(60 * i), at(60 * i + 60), None, 500) for i in range(10)]
    frame = spark.createDataFrame(
        rows, "id bigint, date date, start_ts timestamp_ntz, end_ts timestamp_ntz, teacher_id bigint, room_id bigint"
    )
    found = {r.id: r.component for r in slots.interaction_components(frame, edges_per_task=300).collect()}
    assert found == {**{100 * room + i: 100 * room for room in range(100) for i in range(5)}, **{-1 - i: -1 - i for i in range(10)}}


def test_a_move_over_its_own_empty_slot_still_clashes(spark, tables):
    """The old slot ends before it starts: it was never counted, so it must not be taken off."""
    schedules = [schedule(1, 0, 0, 600, 540), schedule(2, 2, 0, 480, 540)]
    one = spark.createDataFrame([change(1, 1, 0, 480, 720)], CHANGES)
    assert [r.outcome for r in timetable.move(tables(schedules), one.drop("sequence"), DAY).collect()] == ["room"]
    assert outcomes(decided(spark, tables, schedules, [change(1, 1, 0, 480, 720)])) == {1: "room"}


def test_crowded_components_are_thinned_in_a_fixed_number_of_rounds(spark, tables, make, monkeypatch):
    """A long chain through rooms and teachers, settled with components of any size."""
    rounds = []
    settle = timetable._settle
    monkeypatch.setattr(timetable, "_settle", lambda waiting: rounds.append(1) or settle(waiting))
    requests = [(i, i % 12, (i + 1) // 2 % 6, DAY, at(5 * i), at(5 * i + 8)) for i in range(250)]
    frame = make("schedule_requests", requests)
    crowd = timetable.admit_batch(tables([]), frame, rows_per_date=10)
    assert 0 < len(rounds) <= timetable.THINNING_ROUNDS
    whole = timetable.admit_batch(tables([]), frame)
    decisions = lambda d: {r.id: r.outcome for r in d.select("id", F.col("outcome")).collect()}
    assert decisions(crowd) == decisions(whole)
