"""Video-request queries and the same questions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans import requests
from tallyloom.registry.ctes import sql_with
from tallyloom.registry.edge import at_edge
from tallyloom.sources.derived import DerivedTables

AVATAR_ID = 3

REQUIRED_SQL = ", ".join(
    f"CASE WHEN coalesce({name}, '') = '' THEN '{name}_required' END"
    for name in requests.REQUIRED
)

BROKEN_SQL = f"""
    SELECT v.*, a.actor_id, concat_ws(',', {REQUIRED_SQL},
        CASE WHEN length(title) > 100 THEN 'title_length' END,
        CASE WHEN length(v.description) > 100 THEN 'description_length' END,
        CASE WHEN length(transcript) > 1000 THEN 'transcript_length' END,
        CASE WHEN cta_url <> ''
             AND NOT regexp_matches(cta_url, '^(https?|ftp)://[^\\s/?#]+\\.[^\\s]+$')
             THEN 'cta_url_form' END,
        CASE WHEN style = 'circular' AND horizontal_align NOT IN ('none', '')
             THEN 'circular_align' END,
        CASE WHEN horizontal_align NOT IN ('', 'center', 'left', 'right', 'none')
             THEN 'horizontal_align_listed' END,
        CASE WHEN style NOT IN ('', 'rectangular', 'circular') THEN 'style_listed' END,
        CASE WHEN background = 'none_such' THEN 'background_listed' END,
        CASE WHEN short_content_match_mode NOT IN ('', 'freeze', 'loop', 'slow_down')
             THEN 'short_content_match_mode_listed' END,
        CASE WHEN long_content_match_mode NOT IN ('', 'trim', 'speed_up')
             THEN 'long_content_match_mode_listed' END,
        CASE WHEN a.id IS NULL THEN 'avatar_missing' END) AS broken
    FROM video_requests v LEFT JOIN avatars a ON a.id = v.avatar_id"""

PAYLOAD_SQL = """
    SELECT request_id, CAST(json_object('transcript', transcript, 'title', title, 'options',
        json_object('test', true, 'title', title, 'description', description, 'label', cta_label,
            'url', cta_url, 'scriptText', transcript, 'avatar', actor_id, 'voice', voice,
            'horizontalAlign', horizontal_align, 'scale', CAST(1.0 AS DOUBLE), 'style', style,
            'backgroundColor', '#F2F7FF', 'seamless', false, 'background', background,
            'shortBackgroundContentMatchMode', short_content_match_mode,
            'longBackgroundContentMatchMode', long_content_match_mode,
            'soundtrack', sound_track)) AS VARCHAR) AS payload
    FROM checked WHERE broken = ''"""

VOICES_SQL = """
    SELECT v.voice_id, v.language, v.name, v.gender, v.language || ' - ' || v.name AS label
    FROM voices v WHERE v.gender = (SELECT a.gender FROM avatars a WHERE a.id = 3)"""


def _validation(t):
    checked = requests.validate(t, t["video_requests"])
    return checked.select("request_id", F.concat_ws(",", "broken").alias("broken"))


def _payload(t):
    built = requests.payloads(requests.validate(t, t["video_requests"]))
    return built.select("request_id", F.to_json("payload").alias("payload"))


_QUERIES = {
    "request_validation": _validation,
    "request_payload": _payload,
    "avatar_voices": lambda t: requests.voices_for(t, AVATAR_ID),
}


def queries() -> dict:
    def bind(build):
        return lambda spark, folder: at_edge(build(DerivedTables(spark, folder)))

    return {name: bind(build) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "request_validation": sql_with(
            "SELECT request_id, broken FROM checked", checked=BROKEN_SQL
        ),
        "request_payload": sql_with(PAYLOAD_SQL, checked=BROKEN_SQL),
        "avatar_voices": sql_with(VOICES_SQL),
    }
