from __future__ import annotations

import datetime as dt

import pytest

from tallyloom.plans import timetable

D1, D2 = dt.date(2024, 5, 1), dt.date(2024, 5, 2)


def at(day, text):
    return dt.datetime.combine(day, dt.time.fromisoformat(text))


def row(key, lecture, room, day, start, end, *rest):
    return (key, lecture, room, day, at(day, start), at(day, end), *rest)


@pytest.fixture
def tables(make):
    return {
        "rooms": make("rooms", [(1, "Hall", 2), (2, "Lab", 1)]),
        "lectures": make(
            "lectures", [(10, "Maths", 1, 7), (11, "Art", 1, 8), (12, "Music", 1, 7)]
        ),
        "teachers": make("teachers", [(7, "Tom", "tom@x"), (8, "Uma", "uma@x")]),
        "students": make(
            "students", [(1, "R1", "Ann", "ann@x"), (2, "R2", "Ben", "ben@x")]
        ),
        # student 2 is enrolled twice in lecture 10: two seats, one mail
        "lecture_student": make(
            "lecture_student", [(10, 1), (11, 1), (11, 2), (11, 2), (12, 2), (12, 2)]
        ),
        "daily_schedules": make(
            "daily_schedules",
            [
                row(100, 10, 1, D1, "09:00", "10:00", "active"),
                row(101, 11, 2, D1, "13:05", "14:00", "active"),
                row(102, 10, 1, D2, "09:00", "10:00", "active"),
            ],
        ),
        "attendances": make(
            "attendances",
            [(2, 100, 1, "late"), (1, 100, 1, "present"), (3, 102, 2, "absent")],
        ),
    }


def outcomes(decisions):
    return {r.id: r.outcome for r in decisions.collect()}


def test_by_date_shows_completed_and_12_hour_clock(tables):
    found = {r.id: r for r in timetable.by_date(tables, "2024-05-01", D2).collect()}
    assert set(found) == {100, 101}
    assert found[101].start_time_12 == "01:05 PM "
    assert found[100].start_time_12 == "09:00 AM "
    assert (found[100].lecture_name, found[100].teacher_name) == ("Maths", "Tom")
    assert found[100].status == "completed"


def test_only_days_before_are_completed(tables):
    done = timetable.complete_past(tables["daily_schedules"], D2)
    assert {r.id: r.status for r in done.collect()} == {
        100: "completed", 101: "completed", 102: "active",
    }


def test_midnight_clock(make, tables):
    night = make("daily_schedules", [row(1, 10, 1, D1, "00:05", "12:00", "active")])
    found = timetable.by_date({**tables, "daily_schedules": night}, "2024-05-01", D1).first()
    assert (found.start_time_12, found.end_time_12) == ("12:05 AM ", "12:00 PM ")


@pytest.mark.parametrize(
    "text",
    ["2024-05-01", "2024-05-01 18:30:00", "2024-05-01T00:00:00", "2024/5/1", "5/1/2024",
     "01-05-2024", "1.5.2024", "1 May 2024", "May 1, 2024"],
)
def test_date_texts(tables, text):
    assert [r.id for r in timetable.by_room(tables, text, 1).collect()] == [100]


def test_unreadable_date_matches_nothing(tables):
    assert timetable.by_room(tables, "some day", 1).collect() == []


def test_by_student(tables):
    assert [r.id for r in timetable.by_student(tables, "2024-05-01", 2).collect()] == [101]


def test_attendance_takes_the_first_mark_and_null_without_one(tables):
    first = timetable.attendance(tables, "2024-05-01", 10, 1).collect()
    assert [(r.id, r.room_name, r.attendance) for r in first] == [(100, "Hall", "present")]
    none = timetable.attendance(tables, "2024-05-01", 10, 2).collect()
    assert [(r.id, r.attendance) for r in none] == [(100, None)]


def test_admission_reasons_come_in_order(make, tables):
    requests = make(
        "schedule_requests",
        [
            row(1, 11, 2, D1, "08:00", "08:30"),  # 3 enrolled, 1 seat
            row(2, 12, 1, D1, "09:30", "10:30"),  # 2 enrolled, 2 seats; teacher 7 is busy
            row(3, 10, 2, D1, "13:30", "14:30"),  # lab is busy
            row(4, 10, 2, D1, "10:00", "11:00"),  # touches only
            row(5, 10, 9, D1, "10:00", "11:00"),  # no such room
            row(6, 99, 1, D2, "15:00", "16:00"),  # no such lecture
            row(7, 11, 1, D1, "09:15", "09:45"),  # too many students and room busy
        ],
    )
    decided = timetable.admit(tables, requests)
    assert outcomes(decided) == {
        1: "capacity", 2: "teacher", 3: "room", 4: "ok", 5: "room_missing",
        6: "lecture_missing", 7: "capacity",
    }
    texts = {r.id: r.refusal for r in decided.collect()}
    assert texts[1] == "This Lab with capacity 1 Cannot Allocate 3 Students"
    assert texts[4] is None


def test_what_follows_an_admission(make, tables):
    requests = make("schedule_requests", [row(4, 10, 2, D1, "10:00", "11:00")])
    decided = timetable.admit(tables, requests)
    assert timetable.messages(decided).first().message == (
        "A new lecture schedule was created for Maths Room - Lab. Date - 2024-05-01. "
        "From - 10:00:00. To   - 11:00:00."
    )
    assert [tuple(r) for r in timetable.change_log(decided).collect()] == [(4, "create", None)]
    told = {(r.role, r.email) for r in timetable.recipients(tables, decided).collect()}
    assert told == {("teacher", "tom@x"), ("student", "ann@x")}


def test_a_student_enrolled_twice_is_told_once(tables):
    schedule = tables["daily_schedules"].filter("id = 101")
    told = [tuple(r) for r in timetable.recipients(tables, schedule).collect()]
    assert sorted(told) == [
        (101, "student", "ann@x"), (101, "student", "ben@x"), (101, "teacher", "uma@x"),
    ]


def test_moves(make, tables):
    schedules = make(
        "daily_schedules",
        [
            row(100, 10, 1, D2, "09:00", "10:00", "active"),
            row(101, 12, 1, D2, "11:00", "12:00", "active"),
            row(102, 10, 1, D1, "09:00", "10:00", "active"),
            row(103, 10, 2, D2, "15:00", "16:00", "active"),
        ],
    )
    changes = make(
        "schedule_changes",
        [
            (100, 1, D2, at(D2, "09:30"), at(D2, "10:30")),  # onto its own old slot
            (101, 1, D2, at(D2, "09:30"), at(D2, "10:30")),  # onto the slot of 100
            (102, 1, D2, at(D2, "13:00"), at(D2, "14:00")),  # already completed
            (103, 2, D2, at(D2, "11:30"), at(D2, "12:30")),  # teacher busy elsewhere
            (999, 1, D2, at(D2, "18:00"), at(D2, "19:00")),  # no such schedule
        ],
    )
    moved = timetable.move({**tables, "daily_schedules": schedules}, changes, D2)
    assert outcomes(moved) == {
        100: "ok", 101: "teacher", 102: "completed", 103: "teacher", 999: "not_found",
    }
    after = {r.id: r for r in timetable.apply_moves(schedules, moved).collect()}
    assert after[100].start_ts == at(D2, "09:30")
    assert after[100].lecture_id == 10
    assert after[101].start_ts == at(D2, "11:00")
    assert len(after) == 4
    assert [tuple(r) for r in timetable.change_log(moved).collect()] == [(100, "update", D2)]
    assert timetable.messages(moved).first().message == (
        "The Maths lecture on 2024-05-02, was updated to Room - Hall. Date - 2024-05-02. "
        "From - 09:30:00. To   - 10:30:00."
    )
