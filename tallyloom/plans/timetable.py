"""Timetable: look-ups, attendance, admission of new slots, moves, recipients, change log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import clock_12, clock_24, day_of
from tallyloom.functions.fixed_values import (
    CAPACITY_TEXT,
    COMPLETED,
    COMPLETED_TEXT,
    CREATED_MESSAGE,
    MOVED_MESSAGE,
    MOVE_TEACHER_TEXT,
    ROOM_TEXT,
    TEACHER_TEXT,
)
from tallyloom.operators.rows import first_per
from tallyloom.operators.slots import (
    KINDS,
    claims,
    clash_counts,
    interaction_components,
    kind_number,
    lost_by_component,
    lost_in_turn,
    moves_by_component,
    overlaps,
)
from tallyloom.session import ensure_checkpoint_dir

Tables = Mapping[str, DataFrame]

SLOT = ["id", "lecture_id", "room_id", "date", "start_ts", "end_ts"]


# --- look-ups ---------------------------------------------------------------------------------


def complete_past(schedules: DataFrame, as_of: dt.date) -> DataFrame:
    """Schedules before ``as_of`` are completed."""
    past = F.col("date") < F.lit(as_of)
    return schedules.withColumn("status", F.when(past, COMPLETED).otherwise(F.col("status")))


def with_lecture_teacher(tables: Tables, schedules: DataFrame) -> DataFrame:
    lectures = tables["lectures"].select(
        F.col("id").alias("lecture_id"), F.col("name").alias("lecture_name"), "teacher_id"
    )
    teachers = tables["teachers"].select(
        F.col("id").alias("teacher_id"),
        F.col("name").alias("teacher_name"),
        F.col("email").alias("teacher_email"),
    )
    return schedules.join(lectures, "lecture_id", "left").join(teachers, "teacher_id", "left")


def with_room(tables: Tables, schedules: DataFrame) -> DataFrame:
    rooms = tables["rooms"].select(
        F.col("id").alias("room_id"), F.col("name").alias("room_name"), "no_of_seats"
    )
    return schedules.join(rooms, "room_id", "left")


def _on_day(tables: Tables, date: str) -> DataFrame:
    return tables["daily_schedules"].filter(F.col("date") == day_of(date))


def by_date(tables: Tables, date: str, as_of: dt.date) -> DataFrame:
    """Schedules of a day with lecture, teacher and 12-hour clock texts."""
    day = complete_past(_on_day(tables, date), as_of)
    return with_lecture_teacher(tables, day).select(
        "*",
        clock_12("start_ts").alias("start_time_12"),
        clock_12("end_ts").alias("end_time_12"),
    )


def by_student(tables: Tables, date: str, student_id: int) -> DataFrame:
    """Schedules of a day for the lectures one student is enrolled in."""
    enrolled = tables["lecture_student"].filter(F.col("student_id") == student_id)
    day = _on_day(tables, date).join(enrolled.select("lecture_id"), "lecture_id", "left_semi")
    return with_lecture_teacher(tables, day)


def by_room(tables: Tables, date: str, room_id: int) -> DataFrame:
    return _on_day(tables, date).filter(F.col("room_id") == room_id)


def with_attendance(tables: Tables, schedules: DataFrame, student_id: int) -> DataFrame:
    """The first attendance status of a student per schedule, NULL where there is none."""
    marks = tables["attendances"].filter(F.col("student_id") == student_id)
    first = first_per(
        marks.select("daily_schedule_id", "id", "attendance_status"), ["daily_schedule_id"], ["id"]
    ).select(
        F.col("daily_schedule_id").alias("id"), F.col("attendance_status").alias("attendance")
    )
    return schedules.join(first, "id", "left")


def attendance(tables: Tables, date: str, lecture_id: int, student_id: int) -> DataFrame:
    """Schedules of a lecture on a day with room and the student's attendance."""
    found = _on_day(tables, date).filter(F.col("lecture_id") == lecture_id)
    return with_attendance(tables, with_room(tables, found), student_id)


# --- checks -----------------------------------------------------------------------------------


def enrolment(lecture_student: DataFrame) -> DataFrame:
    """Students per lecture."""
    return lecture_student.groupBy("lecture_id").agg(F.count("student_id").alias("n_students"))


def with_teacher(tables: Tables, slots: DataFrame) -> DataFrame:
    lectures = tables["lectures"].select(F.col("id").alias("lecture_id"), "teacher_id")
    return slots.join(lectures, "lecture_id", "left")


def conflicts(
    tables: Tables, requests: DataFrame, kinds: tuple[str, ...] = KINDS
) -> DataFrame:
    """Per request: how many committed schedules of its teacher and of its room it clashes with."""
    wanted, taken = requests, tables["daily_schedules"]
    if "teacher" in kinds:
        wanted, taken = with_teacher(tables, wanted), with_teacher(tables, taken)
    return clash_counts(wanted, taken, kinds)


def teacher_conflicts(tables: Tables, requests: DataFrame) -> DataFrame:
    """Requests that overlap committed schedules of their teacher, with the number of those."""
    return _clashing(tables, requests, "teacher")


def room_conflicts(tables: Tables, requests: DataFrame) -> DataFrame:
    """Requests that overlap committed schedules of their room, with the number of those."""
    return _clashing(tables, requests, "room")


def _clashing(tables: Tables, requests: DataFrame, kind: str) -> DataFrame:
    clashes = F.col(f"{kind}_clashes")
    found = conflicts(tables, requests, (kind,)).filter(clashes > 0)
    return requests.join(found.select("id", clashes.alias("n_clashes")), "id")


def endpoint_conflicts(tables: Tables, requests: DataFrame) -> DataFrame:
    """The weaker test: the start or the end of the request lies in a taken slot."""
    found = conflicts(tables, requests).select(
        "id",
        (F.col("teacher_endpoints") > 0).alias("teacher_busy"),
        (F.col("room_endpoints") > 0).alias("room_busy"),
    )
    return requests.join(found.filter("teacher_busy or room_busy"), "id")


def capacity(tables: Tables, slots: DataFrame) -> DataFrame:
    """Slots with room name, seats and enrolled students; ``fits`` is false when the room is too
    small. As many students as seats still fit; a room without a number of seats takes nobody."""
    students = enrolment(tables["lecture_student"])
    return (
        with_room(tables, slots)
        .join(students, "lecture_id", "left")
        .withColumn("n_students", F.coalesce("n_students", F.lit(0)))
        .withColumn(
            "fits",
            F.when(
                F.col("room_name").isNotNull(),
                F.coalesce(F.col("n_students") <= F.col("no_of_seats"), F.col("n_students") == 0),
            ),
        )
    )


def _verdict(clashes: dict[str, Column], teacher_text: str) -> tuple[Column, Column]:
    """The first failing check, in order, and its text."""

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    checks = [
        ("room_missing", F.col("room_name").isNull(), F.lit("No such room")),
        (
            "capacity",
            ~F.col("fits"),
            F.format_string(
                CAPACITY_TEXT, "room_name", number("no_of_seats"), number("n_students")
            ),
        ),
        ("lecture_missing", F.col("lecture_name").isNull(), F.lit("No such lecture")),
        ("teacher_missing", F.col("teacher_name").isNull(), F.lit("No such teacher")),
        ("teacher", clashes["teacher"], F.lit(teacher_text)),
        ("room", clashes["room"], F.lit(ROOM_TEXT)),
    ]
    outcome = reduce(lambda w, c: w.when(c[1], c[0]), checks, F).otherwise("ok")
    text = reduce(lambda w, c: w.when(c[1], c[2]), checks, F)
    return outcome, text


def admit(tables: Tables, requests: DataFrame) -> DataFrame:
    """Each request against the committed timetable: capacity, then teacher, then room.

    ``outcome`` is ``ok`` or the first failing check, ``refusal`` its text.
    """
    checked = capacity(tables, with_lecture_teacher(tables, requests)).join(
        conflicts(tables, requests), "id", "left"
    )
    clashes = {kind: F.coalesce(F.col(f"{kind}_clashes") > 0, F.lit(False)) for kind in KINDS}
    outcome, refusal = _verdict(clashes, TEACHER_TEXT)
    return checked.select(
        *SLOT,
        "lecture_name",
        "room_name",
        "teacher_id",
        "n_students",
        "no_of_seats",
        outcome.alias("outcome"),
        refusal.alias("refusal"),
    )


# --- batch admission --------------------------------------------------------------------------

CLAIM_MINUTES = 5

# Requests that one task settles in turn without looking further: those of a date, or of a component.
ROWS_PER_DATE = 100_000

# Rounds that thin out a crowded component before the rest of it is settled in turn.
THINNING_ROUNDS = 4

_PLACE = ["date", "kind", "holder", "stretch"]


def admit_batch(
    tables: Tables, requests: DataFrame, rows_per_date: int = ROWS_PER_DATE
) -> DataFrame:
    """Admit a batch as if its requests came one by one in id order: an admitted request takes
    its slot, so a later one that overlaps it is refused. Ids of requests are unique.

    Requests of different dates never meet, so a date with at most ``rows_per_date`` open requests
    is settled in turn by one task. A larger date is cut into components of requests that meet in a
    holder, directly or through others; components are settled apart, each by a task that holds no
    more than the slots its component has taken. A component of more than ``rows_per_date`` requests
    is first thinned out in a fixed number of rounds over claims, one row per stretch of minutes a
    request touches of its room and of its teacher: a request that comes first in every stretch it
    claims is admitted, and the waiting requests that overlap it are out. Admitted slots of one
    holder never overlap, so a stretch is only ever joined to the few slots admitted in it, however
    many requests crowd there. The outcome is the same by any way.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    checked = admit(tables, requests).checkpoint()
    # A teacher taken by the batch also comes before a room taken in the committed timetable.
    candidates = checked.filter(
        F.col("outcome").isin("ok", "room") & (F.col("start_ts") < F.col("end_ts"))
    ).withColumn("open", F.col("outcome") == "ok")
    crowded = _crowded(candidates, "date", rows_per_date)
    if crowded.isEmpty():
        lost = _lost_in_turn(candidates)
    else:
        crowd = candidates.join(crowded, "date", "left_semi")
        lost = _lost_in_turn(candidates.join(crowded, "date", "left_anti")).unionByName(
            _lost_in_components(crowd, rows_per_date)
        )
    text = F.when(F.col("lost") == "teacher", TEACHER_TEXT).when(
        F.col("lost") == "room", ROOM_TEXT
    )
    # A request whose room was already taken stays refused for it unless its teacher is taken too.
    lost = lost.withColumnRenamed("id", "lost_id")
    applies = (F.col("lost") == "teacher") | (F.col("outcome") == "ok")
    kept = [c for c in checked.columns if c not in ("outcome", "refusal")]
    return checked.join(lost, (F.col("id") == F.col("lost_id")) & applies, "left").select(
        *kept,
        F.coalesce("lost", "outcome").alias("outcome"),
        F.coalesce(text, F.col("refusal")).alias("refusal"),
    )


def _crowded(rows: DataFrame, group: str, most: int) -> DataFrame:
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    return sizes.filter(F.col("rows") > most).select(group).checkpoint()


_TURN = ["id", "date", "start_ts", "end_ts", *[f"{kind}_id" for kind in KINDS], "open"]


def _lost_in_turn(candidates: DataFrame) -> DataFrame:
    return candidates.select(*_TURN).groupBy("date").applyInPandas(lost_in_turn, "id bigint, lost string")


def _settled_apart(placed: DataFrame) -> DataFrame:
    in_order = placed.select("component", *_TURN).repartition("component")
    return in_order.sortWithinPartitions("component", "id").mapInArrow(
        lost_by_component, "id bigint, lost string"
    )


def _lost_in_components(crowd: DataFrame, rows_per_component: int) -> DataFrame:
    # requests that only look ask for their teacher alone and join nobody through their room
    room = F.when(F.col("open"), F.col("room_id")).alias("room_id")
    slots = crowd.select("id", "date", "start_ts", "end_ts", "teacher_id", room)
    placed = crowd.join(interaction_components(slots), "id").checkpoint()
    crowded = _crowded(placed, "component", rows_per_component)
    if crowded.isEmpty():
        return _settled_apart(placed)
    apart = _settled_apart(placed.join(crowded, "component", "left_anti"))
    return apart.unionByName(_lost_after_thinning(placed.join(crowded, "component", "left_semi")))


def _lost_after_thinning(placed: DataFrame) -> DataFrame:
    waiting = opened = claims(placed.filter("open"), CLAIM_MINUTES)
    admitted = []
    for _ in range(THINNING_ROUNDS):
        settled = _settle(waiting).checkpoint()
        admitted.append(settled.filter(F.col("won")).select(opened.columns))
        waiting = settled.filter(~F.col("won") & ~F.col("lost")).select(opened.columns)
    # nobody who waits overlaps an admitted slot any more
    tail = placed.join(waiting.select("id").distinct(), "id", "left_semi")
    admitted.append(waiting.join(_settled_apart(tail).checkpoint(), "id", "left_anti"))
    return _lost_to(claims(placed, CLAIM_MINUTES), reduce(DataFrame.unionByName, admitted))


def _settle(waiting: DataFrame) -> DataFrame:
    """Waiting claims with ``won`` (first in all its half-hours) and ``lost`` (overlaps a winner)."""
    earliest = waiting.groupBy(*_PLACE).agg(F.min("id").alias("earliest"))
    seen = waiting.join(earliest, _PLACE).groupBy("id").agg(F.min("earliest").alias("earliest"))
    winners = seen.filter(F.col("earliest") == F.col("id")).select("id")
    rest = waiting.join(winners, "id", "left_anti")
    losers = _rivals(rest, waiting.join(winners, "id", "left_semi")).select("id").distinct()
    return (
        waiting.join(winners.withColumn("won", F.lit(True)), "id", "left")
        .join(losers.withColumn("lost", F.lit(True)), "id", "left")
        .fillna(False, ["won", "lost"])
    )


def _rivals(waiting: DataFrame, taken: DataFrame) -> DataFrame:
    """Claims that overlap an earlier taken claim of the same half-hour and holder."""
    other = taken.select(
        *_PLACE,
        F.col("id").alias("taken_id"),
        F.col("start_ts").alias("taken_start"),
        F.col("end_ts").alias("taken_end"),
    )
    clash = (F.col("taken_id") < F.col("id")) & overlaps(
        F.col("start_ts"), F.col("end_ts"), F.col("taken_start"), F.col("taken_end")
    )
    same_place = reduce(lambda a, b: a & b, [waiting[c] == other[c] for c in _PLACE])
    return waiting.join(other, same_place & clash, "left_semi")


def _lost_to(candidates: DataFrame, admitted: DataFrame) -> DataFrame:
    """Ids refused by an earlier admitted request, with the first failing check."""
    teacher = F.bool_or(F.col("kind") == kind_number("teacher"))
    return (
        _rivals(candidates, admitted)
        .groupBy("id")
        .agg(F.when(teacher, "teacher").otherwise("room").alias("lost"))
    )


# --- moves ------------------------------------------------------------------------------------


def move(tables: Tables, changes: DataFrame, as_of: dt.date) -> DataFrame:
    """Each change of a schedule's date, times and room against the committed timetable, the
    schedule itself left out. The lecture stays. One change per schedule and batch.

    ``outcome`` is ``ok``, ``not_found``, ``completed`` or the first failing check.
    """
    wanted = _with_old_slot(tables, changes, as_of)
    slots = capacity(tables, with_lecture_teacher(tables, wanted))
    checked = slots.join(conflicts(tables, wanted), "id", "left")
    # an old slot without length occupies nothing, so it was not counted
    own = (
        (F.col("old_date") == F.col("date"))
        & (F.col("old_start_ts") < F.col("old_end_ts"))
        & overlaps(F.col("old_start_ts"), F.col("old_end_ts"), F.col("start_ts"), F.col("end_ts"))
    )
    own_of = {"teacher": own, "room": own & (F.col("old_room_id") == F.col("room_id"))}
    clashes = {
        kind: F.coalesce(
            F.col(f"{kind}_clashes") > F.when(own_of[kind], 1).otherwise(0), F.lit(False)
        )
        for kind in KINDS
    }
    outcome, refusal = _verdict(clashes, MOVE_TEACHER_TEXT)
    outcome, refusal = _unless_unmovable(outcome, refusal)
    return checked.select(
        *SLOT, "old_date", "lecture_name", "room_name", "teacher_id", outcome, refusal
    )


def _with_old_slot(tables: Tables, changes: DataFrame, as_of: dt.date) -> DataFrame:
    old = complete_past(tables["daily_schedules"], as_of).select(
        "id",
        "lecture_id",
        "status",
        F.col("date").alias("old_date"),
        F.col("room_id").alias("old_room_id"),
        F.col("start_ts").alias("old_start_ts"),
        F.col("end_ts").alias("old_end_ts"),
    )
    # read by the checks, the counts and the probes: planned once
    ensure_checkpoint_dir(changes.sparkSession)
    return changes.join(old, "id", "left").checkpoint()


def _unless_unmovable(outcome: Column, refusal: Column) -> tuple[Column, Column]:
    missing, done = F.col("status").isNull(), F.col("status") == COMPLETED
    return (
        F.when(missing, "not_found").when(done, "completed").otherwise(outcome).alias("outcome"),
        F.when(missing, "No such schedule")
        .when(done, COMPLETED_TEXT)
        .otherwise(refusal)
        .alias("refusal"),
    )


def move_batch(tables: Tables, changes: DataFrame, as_of: dt.date) -> DataFrame:
    """Moves as if they came one by one in the order of ``sequence``: each sees the places that the
    ones before it gave up and took, those of its own schedule among them.

    ``changes`` has a unique ``sequence``, or one change per schedule in id order without it. The
    checks and outcomes are those of :func:`move`; ``old_date`` is the date on which the schedule
    was when its turn came. A schedule's status, lecture and the capacity of rooms do not change
    within a batch, so they are checked for all changes at once, and so are clashes with schedules
    that the batch does not move. What is left depends on other moves only where they meet in a
    holder. Components of schedules whose old and wanted slots meet, directly or through others,
    are settled apart, each in the order of its changes.
    """
    if "sequence" not in changes.columns:
        changes = changes.withColumn("sequence", F.col("id"))
    wanted = _with_old_slot(tables, changes, as_of)
    repeated = wanted.groupBy("sequence").agg(F.count(F.lit(1)).alias("rows"))
    if not repeated.filter("rows > 1 OR sequence IS NULL").isEmpty():
        raise ValueError("every change needs a sequence of its own")
    outcome, refusal = _unless_unmovable(
        *_verdict({kind: F.lit(False) for kind in KINDS}, MOVE_TEACHER_TEXT)
    )
    judged = (
        capacity(tables, with_lecture_teacher(tables, wanted))
        .select("sequence", *SLOT, "old_date", "lecture_name", "room_name", "teacher_id", outcome, refusal)
        .checkpoint()
    )
    lost = _lost_moves(tables, judged).withColumnRenamed("sequence", "lost_sequence")
    text = F.when(F.col("lost") == "teacher", MOVE_TEACHER_TEXT).when(
        F.col("lost") == "room", ROOM_TEXT
    )
    kept = [c for c in judged.columns if c not in ("old_date", "outcome", "refusal")]
    return judged.join(lost, F.col("sequence") == F.col("lost_sequence"), "left").select(
        *kept,
        F.coalesce("from_date", "old_date").alias("old_date"),
        F.coalesce("lost", "outcome").alias("outcome"),
        F.coalesce(text, F.col("refusal")).alias("refusal"),
    )


def _lost_moves(tables: Tables, judged: DataFrame) -> DataFrame:
    """For changes of schedules that may move: what they are lost to, if anything, and the date
    before them. Changes that are refused already only ask for the date."""
    possible = judged.filter(F.col("outcome") == "ok")
    slot = ["id", "date", "start_ts", "end_ts", *[f"{kind}_id" for kind in KINDS]]
    moving = possible.select("id").distinct()
    schedules = tables["daily_schedules"]
    here = with_teacher(tables, schedules.join(moving, "id", "left_semi")).select(*slot).checkpoint()
    others = {**tables, "daily_schedules": schedules.join(moving, "id", "left_anti")}
    asked = possible.select(F.col("sequence").alias("id"), "lecture_id", "room_id", "date", "start_ts", "end_ts")
    fixed = conflicts(others, asked).select(
        F.col("id").alias("sequence"), *[(F.col(f"{kind}_clashes") > 0).alias(f"{kind}_fixed") for kind in KINDS]
    )
    components = interaction_components(here.unionByName(possible.select(*slot)))
    places = here.select(
        F.lit(False).alias("is_change"),
        F.lit(False).alias("is_refused"),
        F.lit(None).cast("bigint").alias("sequence"),
        *slot,
        *[F.lit(False).alias(f"{kind}_fixed") for kind in KINDS],
    )
    turns = judged.join(fixed, "sequence", "left").select(
        F.lit(True).alias("is_change"),
        (F.col("outcome") != "ok").alias("is_refused"),
        "sequence",
        *slot,
        *[F.coalesce(f"{kind}_fixed", F.lit(False)).alias(f"{kind}_fixed") for kind in KINDS],
    )
    in_order = (
        places.unionByName(turns)
        .join(components, "id")
        .repartition("component")
        .sortWithinPartitions("component", "is_change", "sequence")
    )
    return in_order.mapInArrow(moves_by_component, "sequence bigint, lost string, from_date date")


def last_moves(moves: DataFrame) -> DataFrame:
    """Of the accepted moves of each schedule the last, for :func:`apply_moves`."""
    accepted = moves.filter(F.col("outcome") == "ok").withColumn("turn", -F.col("sequence"))
    return first_per(accepted, ["id"], ["turn"]).drop("turn")


def apply_moves(schedules: DataFrame, moves: DataFrame) -> DataFrame:
    """The timetable after the accepted moves."""
    moved = ["room_id", "date", "start_ts", "end_ts"]
    accepted = moves.filter(F.col("outcome") == "ok").select(
        "id", *[F.col(c).alias(f"new_{c}") for c in moved]
    )
    rest = [c for c in schedules.columns if c not in moved]
    return schedules.join(accepted, "id", "left").select(
        *rest, *[F.coalesce(f"new_{c}", c).alias(c) for c in moved]
    )


# --- what follows an accepted change -------------------------------------------------------------


def messages(decisions: DataFrame) -> DataFrame:
    """The notice of every accepted decision of :func:`admit`, :func:`admit_batch` or
    :func:`move`."""
    when = [
        "room_name",
        F.date_format("date", "yyyy-MM-dd"),
        clock_24("start_ts"),
        clock_24("end_ts"),
    ]
    if "old_date" in decisions.columns:
        text = F.format_string(
            MOVED_MESSAGE, "lecture_name", F.date_format("old_date", "yyyy-MM-dd"), *when
        )
    else:
        text = F.format_string(CREATED_MESSAGE, "lecture_name", *when)
    accepted = decisions.filter(F.col("outcome") == "ok")
    return accepted.select(F.col("id").alias("daily_schedule_id"), text.alias("message"))


def recipients(tables: Tables, schedules: DataFrame) -> DataFrame:
    """Who is told about a schedule: the teacher of its lecture and each enrolled student once.

    The schedules, often the outcome of an admission, are computed once and stored; only students of
    their lectures are looked up.
    """
    ensure_checkpoint_dir(schedules.sparkSession)
    slots = schedules.select(F.col("id").alias("daily_schedule_id"), "lecture_id").checkpoint()
    wanted = slots.select("lecture_id").distinct()
    teachers = tables["teachers"].select(F.col("id").alias("teacher_id"), "email")
    students = tables["students"].select(F.col("id").alias("student_id"), "email")
    taught = tables["lectures"].select(F.col("id").alias("lecture_id"), "teacher_id")
    taught = taught.join(wanted, "lecture_id", "left_semi")
    enrolled = tables["lecture_student"].join(wanted, "lecture_id", "left_semi").distinct()

    def of_lecture(people: DataFrame, role: str) -> DataFrame:
        return people.select("lecture_id", F.lit(role).alias("role"), "email")

    people = of_lecture(taught.join(teachers, "teacher_id"), "teacher").unionByName(
        of_lecture(enrolled.join(students, "student_id"), "student")
    )
    return slots.join(people, "lecture_id").select("daily_schedule_id", "role", "email")


def change_log(decisions: DataFrame) -> DataFrame:
    """Notification rows of the accepted decisions: ``create``, or ``update`` with the old date."""
    accepted = decisions.filter(F.col("outcome") == "ok")
    moved = "old_date" in decisions.columns
    return accepted.select(
        F.col("id").alias("daily_schedule_id"),
        F.lit("update" if moved else "create").alias("action"),
        (F.col("old_date") if moved else F.lit(None).cast("date")).alias("old_date"),
    )
