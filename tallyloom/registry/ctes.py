"""The domain tables as DuckDB SQL over the given tables, and a small WITH builder."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "students": """
        SELECT c_custkey AS id, 'REG' || c_custkey AS registration_no, c_name AS name,
               's' || c_custkey || '@example.test' AS email
        FROM customer""",
    "teachers": """
        SELECT s_suppkey AS id, s_name AS name, 't' || s_suppkey || '@example.test' AS email
        FROM supplier""",
    "lectures": """
        SELECT p_partkey AS id, p_name AS name,
               CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS course_medium_id,
               p_partkey // 20 AS teacher_id
        FROM part""",
    "payments": """
        SELECT p_partkey AS id, p_name AS name, p_partkey // 4 AS lecture_id,
               CAST(p_size AS DECIMAL(18,2)) AS fixed_institute_amount
        FROM part""",
    "student_plans": """
        SELECT c_custkey * 4 + k AS id, (c_custkey * 4 + k) // 3 AS payment_id,
               CASE WHEN k % 2 = 0 THEN 'monthly' ELSE 'card' END AS payment_type
        FROM customer, range(4) AS r(k)""",
    "monthly_payments": """
        SELECT o_orderkey AS id, o_custkey AS student_id,
               o_custkey * 4 + o_orderkey % 4 AS student_payment_id,
               CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
               CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending'
                    ELSE 'cancelled' END AS status,
               CAST(year(o_orderdate) AS INTEGER) AS year,
               CAST(month(o_orderdate) AS INTEGER) AS month,
               o_orderdate AS payment_date
        FROM orders""",
    "shares": """
        SELECT l_orderkey AS monthly_payment_id, l_suppkey AS teacher_id,
               CAST(price * (1 - disc) AS DECIMAL(18,4)) AS teacher_amount,
               CAST(price * disc AS DECIMAL(18,4)) AS institute_amount
        FROM (SELECT l_orderkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
                     CAST(l_discount AS DECIMAL(4,2)) AS disc FROM lineitem)""",
    "rooms": """
        SELECT c_custkey AS id, c_name AS name, CAST(c_custkey % 8 + 6 AS INTEGER) AS no_of_seats
        FROM customer""",
    "lecture_student": """
        SELECT o_orderkey // 8 AS lecture_id, o_custkey AS student_id FROM orders""",
    "slots": """
        SELECT event_id AS id, user_id * 13 + event_id % 13 AS lecture_id, user_id AS room_id,
               CAST(ts AS DATE) AS date, ts AS start_ts, ts + INTERVAL 60 MINUTE AS end_ts,
               event_type
        FROM events""",
    "daily_schedules": """
        SELECT s.id, s.lecture_id, s.room_id, s.date, s.start_ts, s.end_ts, 'active' AS status,
               l.teacher_id
        FROM slots s LEFT JOIN lectures l ON l.id = s.lecture_id
        WHERE s.event_type IN ('view', 'click', 'error')""",
    "schedule_requests": """
        SELECT s.id, s.lecture_id, s.room_id, s.date, s.start_ts, s.end_ts, l.teacher_id
        FROM slots s LEFT JOIN lectures l ON l.id = s.lecture_id
        WHERE s.event_type = 'signup'""",
    "schedule_changes": """
        SELECT id - 1 AS id, room_id, date, start_ts, end_ts FROM slots
        WHERE event_type = 'purchase'""",
    "attendances": """
        SELECT event_id AS id, event_id - event_id % 2 AS daily_schedule_id,
               user_id // 15 AS student_id,
               CASE WHEN value < 10 THEN 'absent' WHEN value < 50 THEN 'late'
                    ELSE 'present' END AS attendance_status
        FROM events""",
    "enrolment": """
        SELECT lecture_id, count(student_id) AS n_students FROM lecture_student GROUP BY 1""",
    "businesses": """
        SELECT s_suppkey AS id, 'biz-' || s_suppkey AS uid FROM supplier""",
    "products": """
        SELECT p_partkey AS id, 'prd-' || p_partkey AS uid, p_partkey % 25 AS account_id,
               p_partkey // 20 AS vendor_id, p_name AS title, p_name AS slug,
               p_type AS description, p_size % 2 AS published_scope,
               CAST(p_retailprice AS DECIMAL(18,2)) AS price, p_size AS inventory_quantity,
               CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 9 END AS action_type,
               TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(p_partkey % 365 AS INTEGER))
                   + to_hours(p_partkey % 24) AS created_at
        FROM part""",
    "categories": """
        SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS id,
               CAST(replace(p_brand, 'Brand#', '') AS BIGINT) % 25 AS account_id,
               lower(p_brand) AS slug
        FROM part""",
    "collections": """
        SELECT p_partkey AS product_id, CAST(replace(p_brand, 'Brand#', '') AS BIGINT)
               AS category_id FROM part
        UNION
        SELECT p_partkey, p_partkey % 25 + 1 FROM part""",
    "feed": """
        SELECT p_partkey AS product_id, p_name AS title, p_type, p_brand, p_size, p_name,
               p_partkey % 25 AS account_id, p_partkey // 20 AS vendor_id,
               CAST(p_retailprice AS DECIMAL(18,2)) AS price, p_size % 4 AS n_images
        FROM part""",
    "revised": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS title, p_type, p_brand,
               p_size, p_name, p_partkey % 25 AS account_id, p_partkey // 20 AS vendor_id,
               CAST(p_retailprice AS DECIMAL(18,2)) AS price, (p_size + 1) % 4 AS n_images
        FROM part WHERE p_type = 'PROMO'""",
    "avatars": """
        SELECT s_suppkey AS id, 'actor-' || s_suppkey AS actor_id,
               CASE WHEN s_suppkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender
        FROM supplier""",
    "voices": """
        SELECT 'voice-' || c_custkey AS voice_id, 'Language ' || c_nationkey AS language,
               c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender
        FROM customer""",
    "page_heads": """
        SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS page_title,
               regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS page_note
        FROM pages""",
    "video_requests": """
        SELECT doc_id AS request_id,
               concat_ws(' ', page_title, CASE WHEN doc_id % 4 <> 0 THEN page_note END) AS title,
               concat_ws(' ', source, page_title, page_note) AS description,
               text AS transcript,
               CASE WHEN doc_id % 17 <> 0 THEN 'Watch' END AS cta_label,
               CASE WHEN doc_id % 9 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END
                   AS cta_url,
               ['center', 'left', 'right', 'none'][doc_id % 4 + 1] AS horizontal_align,
               ['rectangular', 'circular'][(doc_id // 4) % 2 + 1] AS style,
               CASE WHEN doc_id % 19 <> 0 THEN 'voice-' || doc_id END AS voice,
               CASE WHEN doc_id % 23 <> 0 THEN 'calm' END AS sound_track,
               CASE WHEN doc_id % 13 = 0 THEN 'none_such' ELSE [
                   'off_white', 'warm_white', 'light_pink', 'soft_pink', 'light_blue',
                   'dark_blue', 'soft_cyan', 'strong_cyan', 'light_orange', 'soft_orange',
                   'white_studio', 'white_cafe', 'luxury_lobby', 'large_window',
                   'white_meeting_room', 'open_office'][doc_id % 16 + 1] END AS background,
               ['freeze', 'loop', 'slow_down'][doc_id % 3 + 1] AS short_content_match_mode,
               ['trim', 'speed_up'][doc_id % 2 + 1] AS long_content_match_mode,
               doc_id // 9 AS avatar_id
        FROM documents LEFT JOIN page_heads ON page_id = doc_id // 4""",
}


def sql_with(select: str, **extra: str) -> str:
    """``select`` with every domain table it names, directly or through others, put before it.

    ``extra`` adds query-specific tables, in order, after the domain tables.
    """
    body = " ".join([select, *extra.values()])
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(CTES[name])

    visit(body)
    ordered = [name for name in CTES if name in used]
    parts = [f"{name} AS ({CTES[name].strip()})" for name in ordered]
    parts += [f"{name} AS ({text.strip()})" for name, text in extra.items()]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + select.strip()
