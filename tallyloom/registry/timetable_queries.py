"""Timetable queries and the same questions in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.plans import timetable
from tallyloom.registry.ctes import sql_with
from tallyloom.registry.edge import at_edge
from tallyloom.sources.derived import DerivedTables

DAY = "2024-01-12"
AS_OF = dt.date(2024, 1, 10)
ROOM_ID = 9
STUDENT_ID = 5
LECTURE_ID = 122

SLOT_SQL = """s.id, s.lecture_id, s.room_id, strftime(s.date, '%Y-%m-%d') AS date,
    strftime(s.start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts,
    strftime(s.end_ts, '%Y-%m-%d %H:%M:%S') AS end_ts"""

LECTURE_SQL = """l.name AS lecture_name, s.teacher_id, t.name AS teacher_name,
    t.email AS teacher_email"""

LECTURE_JOIN = """LEFT JOIN lectures l ON l.id = s.lecture_id
    LEFT JOIN teachers t ON t.id = s.teacher_id"""

STATUS_SQL = "CASE WHEN s.date < DATE '2024-01-10' THEN 'completed' ELSE s.status END AS status"

OVERLAP = "d.start_ts < r.end_ts AND r.start_ts < d.end_ts"

BUSY_SQL = """
    SELECT r.id,
           count(*) FILTER (WHERE d.teacher_id = r.teacher_id) AS n_teacher,
           count(*) FILTER (WHERE d.room_id = r.room_id) AS n_room
    FROM schedule_requests r JOIN daily_schedules d
      ON d.date = r.date AND (d.teacher_id = r.teacher_id OR d.room_id = r.room_id)
     AND d.start_ts < r.end_ts AND r.start_ts < d.end_ts
    GROUP BY r.id"""

ADMITTED_SQL = """
    SELECT s.*, l.name AS lecture_name, o.name AS room_name, o.no_of_seats,
           coalesce(e.n_students, 0) AS n_students,
           CASE WHEN o.id IS NULL THEN 'room_missing'
                WHEN coalesce(e.n_students, 0) > o.no_of_seats THEN 'capacity'
                WHEN l.id IS NULL THEN 'lecture_missing'
                WHEN t.id IS NULL THEN 'teacher_missing'
                WHEN b.n_teacher > 0 THEN 'teacher'
                WHEN b.n_room > 0 THEN 'room'
                ELSE 'ok' END AS outcome
    FROM schedule_requests s
    LEFT JOIN lectures l ON l.id = s.lecture_id LEFT JOIN teachers t ON t.id = l.teacher_id
    LEFT JOIN rooms o ON o.id = s.room_id LEFT JOIN enrolment e ON e.lecture_id = s.lecture_id LEFT JOIN busy b ON b.id = s.id"""

REFUSAL_SQL = """CASE outcome
    WHEN 'room_missing' THEN 'No such room'
    WHEN 'capacity' THEN 'This ' || room_name || ' with capacity ' || no_of_seats
        || ' Cannot Allocate ' || n_students || ' Students'
    WHEN 'lecture_missing' THEN 'No such lecture'
    WHEN 'teacher_missing' THEN 'No such teacher'
    WHEN 'teacher' THEN 'This Teacher Has Another Lecture at this Schedule Slot'
    WHEN 'room' THEN 'This Schedule Time Slot Is Already Occupied' END AS refusal"""

MOVE_REFUSAL_SQL = REFUSAL_SQL.replace(
    "WHEN 'teacher' THEN 'This Teacher Has Another Lecture at this Schedule Slot'",
    """WHEN 'not_found' THEN 'No such schedule'
    WHEN 'completed' THEN 'Cannot Update Completed Schedule'
    WHEN 'teacher' THEN 'This teacher Has Another lecture at this schedule slot'""",
)

WANTED_MOVES_SQL = """
    SELECT c.id, d.lecture_id, c.room_id, c.date, c.start_ts, c.end_ts, d.teacher_id,
           d.date AS old_date,
           CASE WHEN d.date < DATE '2024-01-10' THEN 'completed' ELSE d.status END AS status
    FROM schedule_changes c LEFT JOIN daily_schedules d ON d.id = c.id"""

MOVE_BUSY_SQL = """
    SELECT r.id,
           count(*) FILTER (WHERE d.teacher_id = r.teacher_id) AS n_teacher,
           count(*) FILTER (WHERE d.room_id = r.room_id) AS n_room
    FROM wanted r JOIN daily_schedules d
      ON d.date = r.date AND d.id <> r.id
     AND (d.teacher_id = r.teacher_id OR d.room_id = r.room_id)
     AND d.start_ts < r.end_ts AND r.start_ts < d.end_ts
    GROUP BY r.id"""

MOVED_SQL = """
    SELECT s.*, l.name AS lecture_name, o.name AS room_name, o.no_of_seats,
           coalesce(e.n_students, 0) AS n_students,
           CASE WHEN s.status IS NULL THEN 'not_found'
                WHEN s.status = 'completed' THEN 'completed'
                WHEN o.id IS NULL THEN 'room_missing'
                WHEN coalesce(e.n_students, 0) > o.no_of_seats THEN 'capacity'
                WHEN l.id IS NULL THEN 'lecture_missing'
                WHEN t.id IS NULL THEN 'teacher_missing'
                WHEN b.n_teacher > 0 THEN 'teacher'
                WHEN b.n_room > 0 THEN 'room'
                ELSE 'ok' END AS outcome
    FROM wanted s
    LEFT JOIN lectures l ON l.id = s.lecture_id LEFT JOIN teachers t ON t.id = l.teacher_id
    LEFT JOIN rooms o ON o.id = s.room_id LEFT JOIN enrolment e ON e.lecture_id = s.lecture_id LEFT JOIN busy_moves b ON b.id = s.id"""

ADMISSION = {"busy": BUSY_SQL, "admitted": ADMITTED_SQL}
MOVES = {"wanted": WANTED_MOVES_SQL, "busy_moves": MOVE_BUSY_SQL, "moved": MOVED_SQL}

# One request after the other inside each date, the admitted ones carried along as a list.
BATCH_SQL = """
    WITH RECURSIVE {tables},
    queue AS (
        SELECT *, row_number() OVER (PARTITION BY date ORDER BY id) AS n FROM admitted
        WHERE outcome = 'ok'),
    steps AS (
        SELECT date, 0 AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS lost,
               CAST([] AS STRUCT(teacher_id BIGINT, room_id BIGINT, s TIMESTAMP, e TIMESTAMP)[])
               AS held
        FROM (SELECT DISTINCT date FROM queue)
        UNION ALL
        SELECT q.date, q.n, q.id, q.lost,
               CASE WHEN q.lost IS NULL THEN list_append(q.held, {{'teacher_id': q.teacher_id,
                   'room_id': q.room_id, 's': q.start_ts, 'e': q.end_ts}}) ELSE q.held END
        FROM (
            SELECT q.*, p.held,
                   CASE WHEN len(list_filter(p.held, lambda x: x.teacher_id = q.teacher_id
                                 AND x.s < q.end_ts AND q.start_ts < x.e)) > 0 THEN 'teacher'
                        WHEN len(list_filter(p.held, lambda x: x.room_id = q.room_id
                                 AND x.s < q.end_ts AND q.start_ts < x.e)) > 0 THEN 'room'
                   END AS lost
            FROM steps p JOIN queue q ON q.date = p.date AND q.n = p.n + 1) q),
    taught AS (
        SELECT DISTINCT s.id
        FROM admitted s JOIN admitted a ON a.date = s.date AND a.teacher_id = s.teacher_id
         AND a.id < s.id AND a.start_ts < s.end_ts AND s.start_ts < a.end_ts
        JOIN steps w ON w.id = a.id AND w.lost IS NULL
        WHERE s.outcome = 'room'),
    batch AS (
        SELECT s.* REPLACE (
            CASE WHEN t.id IS NOT NULL THEN 'teacher' ELSE coalesce(w.lost, s.outcome) END
            AS outcome)
        FROM admitted s LEFT JOIN steps w ON w.id = s.id LEFT JOIN taught t ON t.id = s.id)
    {select}"""


# One change after the other over the whole batch; the places of the schedules that it may move are
# carried along as a list.
MOVE_BATCH_SQL = """
    WITH RECURSIVE {tables}
    batch_changes AS (
        SELECT 2 * id AS sequence, id, room_id, date, start_ts, end_ts FROM schedule_changes
        UNION ALL
        SELECT 2 * c.id + 1, c.id + 2, d.room_id, d.date, d.start_ts, d.end_ts
        FROM schedule_changes c JOIN daily_schedules d ON d.id = c.id),
    batch_wanted AS (
        SELECT c.*, d.lecture_id, d.teacher_id, d.date AS old_date,
               CASE WHEN d.date < DATE '2024-01-10' THEN 'completed' ELSE d.status END AS status
        FROM batch_changes c LEFT JOIN daily_schedules d ON d.id = c.id),
    batch_judged AS (
        SELECT s.*, o.name AS room_name, o.no_of_seats, coalesce(e.n_students, 0) AS n_students,
               CASE WHEN s.status IS NULL THEN 'not_found'
                    WHEN s.status = 'completed' THEN 'completed'
                    WHEN o.id IS NULL THEN 'room_missing'
                    WHEN coalesce(e.n_students, 0) > o.no_of_seats THEN 'capacity'
                    WHEN l.id IS NULL THEN 'lecture_missing'
                    WHEN t.id IS NULL THEN 'teacher_missing' ELSE 'ok' END AS outcome
        FROM batch_wanted s
        LEFT JOIN lectures l ON l.id = s.lecture_id LEFT JOIN teachers t ON t.id = l.teacher_id
        LEFT JOIN rooms o ON o.id = s.room_id LEFT JOIN enrolment e ON e.lecture_id = s.lecture_id),
    batch_moving AS (SELECT DISTINCT id FROM batch_judged WHERE outcome = 'ok'),
    batch_fixed AS (
        SELECT r.sequence, bool_or(d.teacher_id = r.teacher_id) AS teacher_fixed,
               bool_or(d.room_id = r.room_id) AS room_fixed
        FROM batch_judged r JOIN daily_schedules d
          ON d.date = r.date AND (d.teacher_id = r.teacher_id OR d.room_id = r.room_id)
         AND d.start_ts < r.end_ts AND r.start_ts < d.end_ts
        WHERE r.outcome = 'ok' AND d.id NOT IN (SELECT id FROM batch_moving)
        GROUP BY r.sequence),
    queue AS (
        SELECT j.*, coalesce(f.teacher_fixed, false) AS teacher_fixed,
               coalesce(f.room_fixed, false) AS room_fixed,
               row_number() OVER (ORDER BY j.sequence) AS n
        FROM batch_judged j LEFT JOIN batch_fixed f ON f.sequence = j.sequence
        WHERE j.id IN (SELECT id FROM batch_moving)),
    steps AS (
        SELECT 0 AS n, CAST(NULL AS BIGINT) AS sequence, CAST(NULL AS VARCHAR) AS lost,
               CAST(NULL AS DATE) AS from_date,
               list({{'id': d.id, 'teacher_id': d.teacher_id, 'room_id': d.room_id, 'day': d.date,
                      's': d.start_ts, 'e': d.end_ts}}) AS held
        FROM daily_schedules d JOIN batch_moving m ON m.id = d.id
        UNION ALL
        SELECT q.n, q.sequence, q.lost, list_filter(q.held, lambda x: x.id = q.id)[1].day,
               CASE WHEN q.outcome = 'ok' AND q.lost IS NULL
                    THEN list_transform(q.held, lambda x: CASE WHEN x.id = q.id THEN
                        {{'id': q.id, 'teacher_id': q.teacher_id, 'room_id': q.room_id,
                          'day': q.date, 's': q.start_ts, 'e': q.end_ts}} ELSE x END)
                    ELSE q.held END
        FROM (
            SELECT q.*, p.held,
                   CASE WHEN q.outcome <> 'ok' THEN NULL
                        WHEN q.teacher_fixed OR len(list_filter(p.held, lambda x: x.id <> q.id
                             AND x.teacher_id = q.teacher_id AND x.day = q.date
                             AND x.s < q.end_ts AND q.start_ts < x.e)) > 0 THEN 'teacher'
                        WHEN q.room_fixed OR len(list_filter(p.held, lambda x: x.id <> q.id
                             AND x.room_id = q.room_id AND x.day = q.date
                             AND x.s < q.end_ts AND q.start_ts < x.e)) > 0 THEN 'room'
                   END AS lost
            FROM steps p JOIN queue q ON q.n = p.n + 1) q),
    moved_in_turn AS (
        SELECT j.* REPLACE (coalesce(w.lost, j.outcome) AS outcome,
                            coalesce(w.from_date, j.old_date) AS old_date)
        FROM batch_judged j LEFT JOIN steps w ON w.sequence = j.sequence)
    SELECT sequence, id, room_id, strftime(date, '%Y-%m-%d') AS date,
           strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts,
           strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS end_ts,
           coalesce(strftime(old_date, '%Y-%m-%d'), '') AS old_date, outcome,
           coalesce(refusal, '') AS refusal
    FROM (SELECT *, {refusal} FROM moved_in_turn)"""


def _move_batch_sql() -> str:
    tables = sql_with("SELECT 1 /* schedule_changes daily_schedules lectures teachers rooms enrolment */")
    return MOVE_BATCH_SQL.format(
        tables=tables[len("WITH ") :].rsplit("SELECT 1", 1)[0].rstrip() + ",", refusal=MOVE_REFUSAL_SQL
    )


def _with_batch(select: str, **extra: str) -> str:
    """``select`` over ``batch`` and the given tables, behind the recursive WITH of the batch."""
    tables = sql_with(f"SELECT 1 FROM admitted /* {select} */", **extra)
    return BATCH_SQL.format(
        tables=tables[len("WITH ") :].rsplit("SELECT 1", 1)[0], select=select
    )


CREATED_TEXT = """'A new lecture schedule was created for ' || lecture_name || ' Room - '
    || room_name || '. Date - ' || strftime(date, '%Y-%m-%d') || '. From - '
    || strftime(start_ts, '%H:%M:%S') || '. To   - ' || strftime(end_ts, '%H:%M:%S') || '.'"""

MOVED_TEXT = """'The ' || lecture_name || ' lecture on ' || strftime(old_date, '%Y-%m-%d')
    || ', was updated to Room - ' || room_name || '. Date - ' || strftime(date, '%Y-%m-%d')
    || '. From - ' || strftime(start_ts, '%H:%M:%S') || '. To   - '
    || strftime(end_ts, '%H:%M:%S') || '.'"""


def _conflict_sql(column: str) -> str:
    return f"""
        SELECT {SLOT_SQL}, b.n AS n_clashes
        FROM schedule_requests s JOIN (
            SELECT r.id, count(*) AS n FROM schedule_requests r JOIN daily_schedules d
              ON d.date = r.date AND d.{column} = r.{column} AND {OVERLAP}
            GROUP BY r.id) b ON b.id = s.id"""


ENDPOINT_SQL = f"""
    SELECT {SLOT_SQL}, b.teacher_busy, b.room_busy
    FROM schedule_requests s JOIN (
        SELECT r.id, bool_or(d.teacher_id = r.teacher_id) AS teacher_busy,
               bool_or(d.room_id = r.room_id) AS room_busy
        FROM schedule_requests r JOIN daily_schedules d
          ON d.date = r.date AND (d.teacher_id = r.teacher_id OR d.room_id = r.room_id)
         AND (r.start_ts BETWEEN d.start_ts AND d.end_ts
              OR r.end_ts BETWEEN d.start_ts AND d.end_ts)
        GROUP BY r.id) b ON b.id = s.id"""


ATTENDANCE_SQL = f"""
    SELECT {SLOT_SQL}, s.status, o.name AS room_name, o.no_of_seats,
           coalesce(a.attendance_status, 'none') AS attendance
    FROM daily_schedules s LEFT JOIN rooms o ON o.id = s.room_id
    LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY daily_schedule_id ORDER BY id) AS n
        FROM attendances WHERE student_id = {STUDENT_ID}) a
      ON a.daily_schedule_id = s.id AND a.n = 1"""


# --- queries ------------------------------------------------------------------------------------


def _by_date(t):
    return timetable.by_date(t, DAY, AS_OF)


def _by_student(t):
    return timetable.by_student(t, DAY, STUDENT_ID)


def _by_room(t):
    return timetable.by_room(t, DAY, ROOM_ID)


def _attendance(t):
    """Schedules of a day and lecture with room and attendance."""
    marked = timetable.attendance(t, DAY, LECTURE_ID, STUDENT_ID)
    return marked.withColumn("attendance", F.coalesce("attendance", F.lit("none")))


def _attendance_all(t):
    """The same over the whole timetable."""
    marked = timetable.with_attendance(
        t, timetable.with_room(t, t["daily_schedules"]), STUDENT_ID
    )
    return marked.withColumn("attendance", F.coalesce("attendance", F.lit("none")))


def _admit(t):
    return timetable.admit(t, t["schedule_requests"])


def _admission(t):
    return _admit(t).withColumn("refusal", F.coalesce("refusal", F.lit("")))


def _admit_batch(t):
    return timetable.admit_batch(t, t["schedule_requests"])


def _batch(t):
    admitted = _admit_batch(t).select("id", "room_id", "teacher_id", "date", "outcome", "refusal")
    return admitted.withColumn("refusal", F.coalesce("refusal", F.lit("")))


def _moves(t):
    return timetable.move(t, t["schedule_changes"], AS_OF)


def _move(t):
    moves = _moves(t).select("id", "room_id", "date", "start_ts", "end_ts", "outcome", "refusal")
    return moves.withColumn("refusal", F.coalesce("refusal", F.lit("")))


def _chained_changes(t):
    """The given changes, and after each one a second that moves the schedule two ids on to the
    place which the schedule of the first had: free only if the first was accepted."""
    changes = t["schedule_changes"]
    given = changes.withColumn("sequence", F.col("id") * 2)
    first = changes.select("id")
    places = t["daily_schedules"].select("id", "room_id", "date", "start_ts", "end_ts")
    second = first.join(places, "id").select(
        (F.col("id") + 2).alias("id"), "room_id", "date", "start_ts", "end_ts", (F.col("id") * 2 + 1).alias("sequence")
    )
    return given.unionByName(second)


def _move_batch(t):
    moves = timetable.move_batch(t, _chained_changes(t), AS_OF)
    return moves.select(
        "sequence",
        "id",
        "room_id",
        "date",
        "start_ts",
        "end_ts",
        F.coalesce(F.date_format("old_date", "yyyy-MM-dd"), F.lit("")).alias("old_date"),
        "outcome",
        F.coalesce("refusal", F.lit("")).alias("refusal"),
    )


def _moved_timetable(t):
    return timetable.apply_moves(timetable.complete_past(t["daily_schedules"], AS_OF), _moves(t))


def _messages(t):
    return timetable.messages(_admit_batch(t)).unionByName(timetable.messages(_moves(t)))


def _recipients(t):
    admitted = _admit_batch(t).filter(F.col("outcome") == "ok")
    return timetable.recipients(t, admitted)


def _change_log(t):
    log = timetable.change_log(_admit_batch(t)).unionByName(timetable.change_log(_moves(t)))
    return log.withColumn("old_date", F.coalesce(F.date_format("old_date", "yyyy-MM-dd"), F.lit("")))


def _capacity(t):
    return timetable.capacity(t, t["schedule_requests"])


_QUERIES = {
    "schedule_by_date": _by_date,
    "schedule_by_student": _by_student,
    "schedule_by_room": _by_room,
    "schedule_attendance": _attendance,
    "schedule_attendance_all": _attendance_all,
    "lecture_enrolment": lambda t: timetable.enrolment(t["lecture_student"]),
    "schedule_capacity": _capacity,
    "schedule_teacher_conflict": lambda t: timetable.teacher_conflicts(t, t["schedule_requests"]),
    "schedule_room_conflict": lambda t: timetable.room_conflicts(t, t["schedule_requests"]),
    "schedule_endpoint_conflict": lambda t: timetable.endpoint_conflicts(
        t, t["schedule_requests"]
    ),
    "schedule_admission": _admission,
    "schedule_admission_batch": _batch,
    "schedule_move": _move,
    "schedule_move_batch": _move_batch,
    "schedule_moved_timetable": _moved_timetable,
    "schedule_complete_past": lambda t: timetable.complete_past(t["daily_schedules"], AS_OF),
    "schedule_messages": _messages,
    "schedule_recipients": _recipients,
    "schedule_change_log": _change_log,
}


def queries() -> dict:
    def bind(build):
        return lambda spark, folder: at_edge(build(DerivedTables(spark, folder)))

    return {name: bind(build) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    both = {**ADMISSION, **MOVES}
    return {
        "schedule_by_date": sql_with(f"""
            SELECT {SLOT_SQL}, {STATUS_SQL}, {LECTURE_SQL},
                   strftime(s.start_ts, '%I:%M %p ') AS start_time_12,
                   strftime(s.end_ts, '%I:%M %p ') AS end_time_12
            FROM daily_schedules s {LECTURE_JOIN} WHERE s.date = DATE '{DAY}'"""),
        "schedule_by_student": sql_with(f"""
            SELECT {SLOT_SQL}, s.status, {LECTURE_SQL} FROM daily_schedules s {LECTURE_JOIN}
            WHERE s.date = DATE '{DAY}' AND s.lecture_id IN (
                SELECT lecture_id FROM lecture_student WHERE student_id = {STUDENT_ID})"""),
        "schedule_by_room": sql_with(f"""
            SELECT {SLOT_SQL}, s.status FROM daily_schedules s
            WHERE s.date = DATE '{DAY}' AND s.room_id = {ROOM_ID}"""),
        "schedule_attendance": sql_with(
            f"{ATTENDANCE_SQL} WHERE s.date = DATE '{DAY}' AND s.lecture_id = {LECTURE_ID}"
        ),
        "schedule_attendance_all": sql_with(ATTENDANCE_SQL),
        "lecture_enrolment": sql_with("SELECT lecture_id, n_students FROM enrolment"),
        "schedule_capacity": sql_with(f"""
            SELECT {SLOT_SQL}, o.name AS room_name, o.no_of_seats,
                   coalesce(e.n_students, 0) AS n_students,
                   coalesce(e.n_students, 0) <= o.no_of_seats AS fits
            FROM schedule_requests s LEFT JOIN rooms o ON o.id = s.room_id
            LEFT JOIN enrolment e ON e.lecture_id = s.lecture_id"""),
        "schedule_teacher_conflict": sql_with(_conflict_sql("teacher_id")),
        "schedule_room_conflict": sql_with(_conflict_sql("room_id")),
        "schedule_endpoint_conflict": sql_with(ENDPOINT_SQL),
        "schedule_admission": sql_with(
            f"""SELECT {SLOT_SQL}, lecture_name, room_name, teacher_id, n_students, no_of_seats,
                       outcome, coalesce(refusal, '') AS refusal
                FROM (SELECT *, {REFUSAL_SQL} FROM admitted) s""",
            **ADMISSION,
        ),
        "schedule_admission_batch": _with_batch(
            f"""SELECT id, room_id, teacher_id, strftime(date, '%Y-%m-%d') AS date, outcome,
                       coalesce(refusal, '') AS refusal
                FROM (SELECT *, {REFUSAL_SQL} FROM batch)""",
            **ADMISSION,
        ),
        "schedule_move": sql_with(
            """SELECT id, room_id, strftime(date, '%Y-%m-%d') AS date,
                      strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts,
                      strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS end_ts, outcome,
                      coalesce(refusal, '') AS refusal
               FROM (SELECT *, """
            + MOVE_REFUSAL_SQL
            + " FROM moved)",
            **MOVES,
        ),
        "schedule_move_batch": _move_batch_sql(),
        "schedule_moved_timetable": sql_with(
            """SELECT s.id, s.lecture_id, coalesce(m.room_id, s.room_id) AS room_id,
                      strftime(coalesce(m.date, s.date), '%Y-%m-%d') AS date,
                      strftime(coalesce(m.start_ts, s.start_ts), '%Y-%m-%d %H:%M:%S') AS start_ts,
                      strftime(coalesce(m.end_ts, s.end_ts), '%Y-%m-%d %H:%M:%S') AS end_ts,
                      """
            + STATUS_SQL
            + """ FROM daily_schedules s
                  LEFT JOIN moved m ON m.id = s.id AND m.outcome = 'ok'""",
            **MOVES,
        ),
        "schedule_complete_past": sql_with(
            f"SELECT {SLOT_SQL}, {STATUS_SQL} FROM daily_schedules s"
        ),
        "schedule_messages": _with_batch(
            f"""SELECT id AS daily_schedule_id, {CREATED_TEXT} AS message FROM batch
                WHERE outcome = 'ok'
                UNION ALL
                SELECT id, {MOVED_TEXT} FROM moved WHERE outcome = 'ok'""",
            **both,
        ),
        "schedule_recipients": _with_batch(
            """SELECT a.id AS daily_schedule_id, 'teacher' AS role, t.email
               FROM batch a JOIN teachers t ON t.id = a.teacher_id WHERE outcome = 'ok'
               UNION ALL
               SELECT a.id, 'student', st.email FROM batch a JOIN students st
                 ON st.id IN (SELECT student_id FROM lecture_student e
                              WHERE e.lecture_id = a.lecture_id)
               WHERE outcome = 'ok'""",
            **ADMISSION,
        ),
        "schedule_change_log": _with_batch(
            """SELECT id AS daily_schedule_id, 'create' AS action, '' AS old_date FROM batch
               WHERE outcome = 'ok'
               UNION ALL
               SELECT id, 'update', strftime(old_date, '%Y-%m-%d') FROM moved
               WHERE outcome = 'ok'""",
            **both,
        ),
    }
