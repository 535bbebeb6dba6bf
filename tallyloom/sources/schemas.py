"""Declared schemas of the domain tables.

Wall-clock columns are ``timestamp_ntz``: a timetable and a payment date carry no zone, so results
do not move with the session time zone. Money is decimal and stays decimal through every sum.
"""

from __future__ import annotations

# ``place`` is the child's place in the list of its product.
_CHILD = "id bigint, product_id bigint, place bigint"

TABLE_SCHEMAS: dict[str, str] = {
    # fee report
    "students": "id bigint, registration_no string, name string, email string",
    "teachers": "id bigint, name string, email string",
    "lectures": "id bigint, name string, course_medium_id bigint, teacher_id bigint",
    "payments": "id bigint, name string, lecture_id bigint, fixed_institute_amount decimal(18,2)",
    "student__payments": "id bigint, student_id bigint, payment_id bigint, payment_type string",
    "monthly_payments": "id bigint, student_id bigint, student_payment_id bigint, "
    "amount decimal(18,2), status string, year int, month int, payment_date timestamp_ntz",
    "teacher_institute_shares": "monthly_payment_id bigint, teacher_id bigint, "
    "teacher_amount decimal(18,4), institute_amount decimal(18,4)",
    # timetable
    "rooms": "id bigint, name string, no_of_seats int",
    "lecture_student": "lecture_id bigint, student_id bigint",
    "daily_schedules": "id bigint, lecture_id bigint, room_id bigint, date date, "
    "start_ts timestamp_ntz, end_ts timestamp_ntz, status string",
    "schedule_requests": "id bigint, lecture_id bigint, room_id bigint, date date, "
    "start_ts timestamp_ntz, end_ts timestamp_ntz",
    "schedule_changes": "id bigint, room_id bigint, date date, start_ts timestamp_ntz, "
    "end_ts timestamp_ntz",
    "schedule_notifications": "daily_schedule_id bigint, action string, old_date date",
    "attendances": "id bigint, daily_schedule_id bigint, student_id bigint, "
    "attendance_status string",
    # catalogue
    "products": "id bigint, uid string, account_id bigint, vendor_id bigint, title string, "
    "slug string, description string, except string, published_scope int, currency string, "
    "price decimal(18,2), compare_at_price decimal(18,2), inventory_quantity int, "
    "min_purchase_quantity int, metric string, action_type int, action_date timestamp_ntz, "
    "created_at timestamp_ntz",
    "businesses": "id bigint, uid string",
    "categories": "id bigint, account_id bigint, slug string",
    "collections": "product_id bigint, category_id bigint",
    "images": f"{_CHILD}, position int, alt string, src string, width int, height int",
    "videos": f"{_CHILD}, title string, url string, description string",
    "documents": f"{_CHILD}, title string, description string, src string, kind string, "
    "position int",
    "metadata": f"{_CHILD}, metafield_id bigint, name string, label string, kind int",
    "options": f"{_CHILD}, name string, value string, position int",
    "variants": f"{_CHILD}, title string, price decimal(18,2), sku string, position int, "
    "inventory_policy string, compare_at_price decimal(18,2), fulfillment_service string, "
    "inventory_management string, taxable string, barcode string, grams int, weight double, "
    "weight_unit string, inventory_quantity int, requires_shipping string",
    "option_variants": "product_id bigint, option_id bigint, variant_id bigint, value string",
    # requests
    "video_requests": "request_id bigint, title string, description string, transcript string, "
    "cta_label string, cta_url string, horizontal_align string, style string, voice string, "
    "sound_track string, background string, short_content_match_mode string, "
    "long_content_match_mode string, avatar_id bigint",
    "avatars": "id bigint, actor_id string, gender string",
    "voices": "voice_id string, language string, name string, gender string",
}

# One row of the product feed: header fields and seven nested lists, variants two deep. Numbers come
# as JSON numbers or as text, so they are read as text; names and option values may be lists or single
# values, so they are read as they are.
FEED_PAYLOAD = """
    business_uid string, account_id string, title string, description string, except string,
    published_scope string, currency string, price string, compare_at_price string,
    inventory_quantity string, min_purchase_quantity string, metric string,
    images array<struct<position:string, alt:string, src:string, width:string, height:string>>,
    categories array<string>,
    videos array<struct<title:string, url:string, description:string>>,
    documents array<struct<title:string, description:string, src:string, kind:string,
                           position:string>>,
    metadata array<struct<metafield_id:string, name:variant, label:string, kind:string>>,
    options array<struct<name:string, value:variant, position:string>>,
    variants array<struct<title:string, price:string, sku:string, position:string,
        inventory_policy:string, compare_at_price:string, fulfillment_service:string,
        inventory_management:string, taxable:string, barcode:string, grams:string, weight:string,
        weight_unit:string, inventory_quantity:string, requires_shipping:string,
        options:array<struct<option:string, value:string>>>>
"""

# The numbers among these fields: of the header (list "") and of the items of each list.
FEED_NUMBERS = {
    "": {
        "account_id": "bigint",
        "price": "decimal(18,2)",
        "compare_at_price": "decimal(18,2)",
        "inventory_quantity": "int",
        "min_purchase_quantity": "int",
    },
    "images": {"position": "int", "width": "int", "height": "int"},
    "documents": {"position": "int"},
    "metadata": {"metafield_id": "bigint", "kind": "int"},
    "options": {"position": "int"},
    "variants": {
        "price": "decimal(18,2)",
        "position": "int",
        "compare_at_price": "decimal(18,2)",
        "grams": "int",
        "weight": "double",
        "inventory_quantity": "int",
    },
}
