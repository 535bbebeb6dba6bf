"""Domain tables derived from the given tables, each over the whole of its source.

Keys of the given tables run densely from 0 and their sizes keep fixed proportions, so a whole
division spreads one key range over another without counting, joining or filtering anything.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tallyloom.functions.fixed_values import (
    ALIGNMENTS,
    BACKGROUNDS,
    DRAFT,
    LIVE,
    LONG_MATCH_MODES,
    SHORT_MATCH_MODES,
    STYLES,
)
from tallyloom.sources.lazy import LazyTables
from tallyloom.sources.raw import read_raw

BRAND_NUMBER = "CAST(substring_index(p_brand, '#', -1) AS BIGINT)"


def _sql_list(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{value}'" for value in values) + ")"


def _pick(values: list[str], index: str) -> str:
    """The value at ``index`` modulo the list length, without a join."""
    return f"{_sql_list(values)}[CAST({index} % {len(values)} AS INT)]"


class DerivedTables(LazyTables):
    """All domain tables over one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        raw = partial(read_raw, spark, folder)
        super().__init__({name: partial(build, raw) for name, build in _BUILDERS.items()})


# --- fee report -------------------------------------------------------------------------------


def _students(raw) -> DataFrame:
    return raw("customer").selectExpr(
        "c_custkey AS id",
        "concat('REG', c_custkey) AS registration_no",
        "c_name AS name",
        "concat('s', c_custkey, '@example.test') AS email",
    )


def _teachers(raw) -> DataFrame:
    return raw("supplier").selectExpr(
        "s_suppkey AS id", "s_name AS name", "concat('t', s_suppkey, '@example.test') AS email"
    )


def _lectures(raw) -> DataFrame:
    return raw("part").selectExpr(
        "p_partkey AS id",
        "p_name AS name",
        f"{BRAND_NUMBER} AS course_medium_id",
        "p_partkey div 20 AS teacher_id",
    )


def _payments(raw) -> DataFrame:
    return raw("part").selectExpr(
        "p_partkey AS id",
        "p_name AS name",
        "p_partkey div 4 AS lecture_id",
        "CAST(p_size AS DECIMAL(18,2)) AS fixed_institute_amount",
    )


def _student_payments(raw) -> DataFrame:
    plans = raw("customer").selectExpr("c_custkey", "explode(array(0, 1, 2, 3)) AS k")
    return plans.selectExpr(
        "c_custkey * 4 + k AS id",
        "c_custkey AS student_id",
        "(c_custkey * 4 + k) div 3 AS payment_id",
        "if(k % 2 = 0, 'monthly', 'card') AS payment_type",
    )


def _monthly_payments(raw) -> DataFrame:
    return raw("orders").selectExpr(
        "o_orderkey AS id",
        "o_custkey AS student_id",
        "o_custkey * 4 + o_orderkey % 4 AS student_payment_id",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS amount",
        "CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'pending' "
        "ELSE 'cancelled' END AS status",
        "year(o_orderdate) AS year",
        "month(o_orderdate) AS month",
        "o_orderdate AS payment_date",
    )


def _teacher_institute_shares(raw) -> DataFrame:
    price = "CAST(l_extendedprice AS DECIMAL(18,2))"
    discount = "CAST(l_discount AS DECIMAL(4,2))"
    return raw("lineitem").selectExpr(
        "l_orderkey AS monthly_payment_id",
        "l_suppkey AS teacher_id",
        f"CAST({price} * (1 - {discount}) AS DECIMAL(18,4)) AS teacher_amount",
        f"CAST({price} * {discount} AS DECIMAL(18,4)) AS institute_amount",
    )


# --- timetable --------------------------------------------------------------------------------


def _rooms(raw) -> DataFrame:
    return raw("customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "CAST(c_custkey % 8 + 6 AS INT) AS no_of_seats"
    )


def _lecture_student(raw) -> DataFrame:
    return raw("orders").selectExpr("o_orderkey div 8 AS lecture_id", "o_custkey AS student_id")


# Every event type feeds exactly one of the three timetable inputs.
SCHEDULE_EVENTS = "event_type IN ('view', 'click', 'error')"
REQUEST_EVENTS = "event_type = 'signup'"
CHANGE_EVENTS = "event_type = 'purchase'"

_WHEN = ("CAST(ts AS DATE) AS date", "ts AS start_ts", "ts + INTERVAL 60 MINUTES AS end_ts")
_SLOT = (
    "event_id AS id",
    "user_id * 13 + event_id % 13 AS lecture_id",
    "user_id AS room_id",
    *_WHEN,
)


def _daily_schedules(raw) -> DataFrame:
    return raw("events").filter(SCHEDULE_EVENTS).selectExpr(*_SLOT, "'active' AS status")


def _schedule_requests(raw) -> DataFrame:
    return raw("events").filter(REQUEST_EVENTS).selectExpr(*_SLOT)


def _schedule_changes(raw) -> DataFrame:
    """A change names the event just before it; where that is no schedule, the id is unknown."""
    changes = raw("events").filter(CHANGE_EVENTS)
    return changes.selectExpr("event_id - 1 AS id", "user_id AS room_id", *_WHEN)


def _attendances(raw) -> DataFrame:
    return raw("events").selectExpr(
        "event_id AS id",
        "event_id - event_id % 2 AS daily_schedule_id",
        "user_id div 15 AS student_id",
        "CASE WHEN value < 10 THEN 'absent' WHEN value < 50 THEN 'late' ELSE 'present' END "
        "AS attendance_status",
    )


# --- catalogue --------------------------------------------------------------------------------


def _businesses(raw) -> DataFrame:
    return raw("supplier").selectExpr("s_suppkey AS id", "concat('biz-', s_suppkey) AS uid")


def _products(raw) -> DataFrame:
    created = (
        "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval("
        "CAST(p_partkey % 365 AS INT), CAST(p_partkey % 24 AS INT))"
    )
    return raw("part").selectExpr(
        "p_partkey AS id",
        "concat('prd-', p_partkey) AS uid",
        "p_partkey % 25 AS account_id",
        "p_partkey div 20 AS vendor_id",
        "p_name AS title",
        "p_name AS slug",
        "p_type AS description",
        "'' AS `except`",
        "p_size % 2 AS published_scope",
        "'' AS currency",
        "CAST(p_retailprice AS DECIMAL(18,2)) AS price",
        "CAST(NULL AS DECIMAL(18,2)) AS compare_at_price",
        "p_size AS inventory_quantity",
        "CAST(NULL AS INT) AS min_purchase_quantity",
        "'' AS metric",
        f"if(p_partkey % 3 = 0, {DRAFT}, {LIVE}) AS action_type",
        f"{created} AS action_date",
        f"{created} AS created_at",
    )


def _categories(raw) -> DataFrame:
    brands = raw("part").select("p_brand").distinct()
    return brands.selectExpr(
        f"{BRAND_NUMBER} AS id", f"{BRAND_NUMBER} % 25 AS account_id", "lower(p_brand) AS slug"
    )


def _collections(raw) -> DataFrame:
    return raw("part").selectExpr(
        "p_partkey AS product_id",
        f"explode(array_distinct(array({BRAND_NUMBER}, p_partkey % 25 + 1))) AS category_id",
    )


def _items(n: int, count: str, item: str) -> str:
    """A list of ``count`` items, at most ``n``, each built from its index ``i``."""
    indexes = ", ".join(str(i) for i in range(n))
    return f"transform(filter(array({indexes}), i -> i < {count}), i -> {item})"


def _feed(parts: DataFrame, title: str, n_images: str, sequence: int = 1) -> DataFrame:
    """Product feed as it arrives: a product id, a delivery number and one JSON text."""
    price = "CAST(p_retailprice AS DECIMAL(18,2))"
    images = (
        "named_struct('position', i, 'alt', concat('view ', i), "
        "'src', concat('img/', p_partkey, '/', i), 'width', 640)"
    )
    videos = (
        "named_struct('title', p_name, "
        "'url', concat('https://video.example.test/', p_partkey))"
    )
    documents = (
        "array(named_struct('title', concat('Sheet ', p_partkey), "
        "'src', concat('doc/', p_partkey), 'kind', 'pdf', 'position', 0))"
    )
    metadata = (
        "array(named_struct('metafield_id', 1, "
        "'name', to_variant_object(array(p_type, p_brand)), 'label', 'tags', 'kind', 7), "
        "named_struct('metafield_id', 2, 'name', CAST(p_brand AS VARIANT), "
        "'label', CAST(NULL AS STRING), 'kind', 1))"
    )
    options = (
        "array(named_struct('name', 'size', 'value', to_variant_object(array('S', 'M')), "
        "'position', 0), "
        "named_struct('name', 'type', 'value', CAST(p_type AS VARIANT), 'position', 1))"
    )
    variants = (
        f"named_struct('title', concat(p_name, ' v', i), 'price', {price} + i, "
        "'sku', concat('sku-', p_partkey, '-', i), 'position', i, "
        "'options', array(named_struct("
        "'option', if(p_partkey % 10 = 0, 'colour', 'size'), "
        "'value', if(i % 2 = 0, 'S', 'M'))))"
    )
    fields = {
        "business_uid": "concat('biz-', p_partkey div 20)",
        "account_id": "p_partkey % 25",
        "title": title,
        "description": "p_type",
        "price": price,
        "inventory_quantity": "if(p_partkey % 50 = 0, 'many', CAST(p_size AS STRING))",
        "images": _items(4, n_images, images),
        "categories": "array(lower(p_brand), 'unknown')",
        "videos": _items(1, "p_size % 2", videos),
        "documents": documents,
        "metadata": metadata,
        "options": options,
        "variants": _items(3, "p_partkey % 3 + 1", variants),
    }
    payload = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return parts.selectExpr(
        "p_partkey AS product_id",
        f"{sequence} AS sequence",
        f"to_json(named_struct({payload})) AS payload",
    )


def _product_feed(raw) -> DataFrame:
    """Some products are delivered twice; the later delivery counts."""
    stale = _feed(raw("part").filter("p_partkey % 7 = 0"), "'stale'", "0", 1)
    return stale.unionByName(_feed(raw("part"), "p_name", "p_size % 4", 2))


def _revised_feed(raw) -> DataFrame:
    """A second delivery: one product type only, other image counts, some titles changed."""
    return _feed(
        raw("part").filter("p_type = 'PROMO'"),
        "if(p_size > 25, upper(p_name), p_name)",
        "(p_size + 1) % 4",
    )


def _drifted_feed(raw) -> DataFrame:
    """A delivery by another version of the sender: fields that are new, moved or of another kind."""
    variant = (
        "named_struct('title', p_name, 'sku', array(p_brand), "
        "'options', array(named_struct('option', 'size', 'value', 'S', 'unit', 'EU')))"
    )
    fields = {
        "title": "p_name",
        "colour": "p_brand",
        "price": "named_struct('amount', p_size)",
        "images": _items(4, "p_size % 4", "named_struct('src', 'a', 'depth', i)"),
        "videos": "if(p_size % 2 = 0, 'none', NULL)",
        "metadata": "array(named_struct('metafield_id', 1, 'name', array(p_type)))",
        "variants": f"array({variant})",
    }
    payload = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return raw("part").selectExpr(
        "p_partkey AS product_id",
        f"if(p_type = 'PROMO', concat('[', p_partkey, ']'), to_json(named_struct({payload}))) AS payload",
    )


# --- requests ---------------------------------------------------------------------------------


def _avatars(raw) -> DataFrame:
    return raw("supplier").selectExpr(
        "s_suppkey AS id",
        "concat('actor-', s_suppkey) AS actor_id",
        "if(s_suppkey % 2 = 0, 'female', 'male') AS gender",
    )


def _voices(raw) -> DataFrame:
    return raw("customer").selectExpr(
        "concat('voice-', c_custkey) AS voice_id",
        "concat('Language ', c_nationkey) AS language",
        "c_name AS name",
        "if(c_custkey % 2 = 0, 'female', 'male') AS gender",
    )


def _video_requests(raw) -> DataFrame:
    """One request per document: the whole text is read out, title and link come from its page."""
    pages = raw("pages").selectExpr(
        "page_id",
        "url",
        "regexp_extract(html, '<title>([^<]*)</title>', 1) AS page_title",
        "regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1) AS page_note",
    )
    docs = raw("documents").selectExpr("doc_id", "text", "source", "doc_id div 4 AS page_id")
    background = _pick(BACKGROUNDS, "doc_id")
    return docs.join(pages, "page_id", "left").selectExpr(
        "doc_id AS request_id",
        "concat_ws(' ', page_title, if(doc_id % 4 != 0, page_note, NULL)) AS title",
        "concat_ws(' ', source, page_title, page_note) AS description",
        "text AS transcript",
        "if(doc_id % 17 != 0, 'Watch', NULL) AS cta_label",
        "if(doc_id % 9 = 0, regexp_replace(url, '^https?://', ''), url) AS cta_url",
        f"{_pick(ALIGNMENTS, 'doc_id')} AS horizontal_align",
        f"{_pick(STYLES, '(doc_id div 4)')} AS style",
        "if(doc_id % 19 != 0, concat('voice-', doc_id), NULL) AS voice",
        "if(doc_id % 23 != 0, 'calm', NULL) AS sound_track",
        f"if(doc_id % 13 = 0, 'none_such', {background}) AS background",
        f"{_pick(SHORT_MATCH_MODES, 'doc_id')} AS short_content_match_mode",
        f"{_pick(LONG_MATCH_MODES, 'doc_id')} AS long_content_match_mode",
        "doc_id div 9 AS avatar_id",
    )


_BUILDERS = {
    "students": _students,
    "teachers": _teachers,
    "lectures": _lectures,
    "payments": _payments,
    "student__payments": _student_payments,
    "monthly_payments": _monthly_payments,
    "teacher_institute_shares": _teacher_institute_shares,
    "rooms": _rooms,
    "lecture_student": _lecture_student,
    "daily_schedules": _daily_schedules,
    "schedule_requests": _schedule_requests,
    "schedule_changes": _schedule_changes,
    "attendances": _attendances,
    "businesses": _businesses,
    "products": _products,
    "categories": _categories,
    "collections": _collections,
    "product_feed": _product_feed,
    "revised_feed": _revised_feed,
    "drifted_feed": _drifted_feed,
    "avatars": _avatars,
    "voices": _voices,
    "video_requests": _video_requests,
}
