from __future__ import annotations

import pytest

from tallyloom.plans import requests
from tallyloom.sources.schemas import TABLE_SCHEMAS

COLUMNS = [part.strip().split()[0] for part in TABLE_SCHEMAS["video_requests"].split(",")]

GOOD = {
    "request_id": 1, "title": "T", "description": "D", "transcript": "Hello", "cta_label": "Go",
    "cta_url": "https://a.b/c", "horizontal_align": "left", "style": "rectangular", "voice": "v",
    "sound_track": "calm", "background": "off_white", "short_content_match_mode": "loop",
    "long_content_match_mode": "trim", "avatar_id": 1,
}


@pytest.fixture
def tables(make):
    return {
        "avatars": make("avatars", [(1, "actor-1", "female"), (2, "actor-2", "male")]),
        "voices": make(
            "voices",
            [("v1", "English", "Amy", "female"), ("v2", "Irish", "Bob", "male"),
             ("v3", "Welsh", "Cat", "female")],
        ),
    }


def broken(make, tables, **changes):
    row = {**GOOD, **changes}
    frame = make("video_requests", [[row[c] for c in COLUMNS]])
    return requests.validate(tables, frame).first().broken


def test_a_good_request(make, tables):
    assert broken(make, tables) == []


@pytest.mark.parametrize("name", requests.REQUIRED)
@pytest.mark.parametrize("empty", [None, ""], ids=["null", "empty"])
def test_required(make, tables, name, empty):
    assert broken(make, tables, **{name: empty}) == [f"{name}_required"]


@pytest.mark.parametrize(
    "changes, rules",
    [
        ({"title": "x" * 100}, []),
        ({"title": "x" * 101}, ["title_length"]),
        ({"description": "ü" * 100}, []),
        ({"description": "x" * 101}, ["description_length"]),
        ({"transcript": "x" * 1000}, []),
        ({"transcript": "x" * 1001}, ["transcript_length"]),
        ({"cta_url": "a.b/c"}, ["cta_url_form"]),
        ({"cta_url": "ftp://a.b"}, []),
        ({"cta_url": "http://localhost"}, ["cta_url_form"]),
        ({"style": "circular"}, ["circular_align"]),
        ({"style": "circular", "horizontal_align": "none"}, []),
        ({"style": "circular", "horizontal_align": ""}, ["horizontal_align_required"]),
        ({"style": "square"}, ["style_listed"]),
        ({"background": "none_such"}, ["background_listed"]),
        ({"horizontal_align": "top"}, ["horizontal_align_listed"]),
        ({"short_content_match_mode": "trim"}, ["short_content_match_mode_listed"]),
        ({"long_content_match_mode": "loop"}, ["long_content_match_mode_listed"]),
        ({"avatar_id": 9}, ["avatar_missing"]),
        ({"avatar_id": None}, ["avatar_missing"]),
        (
            {"title": "", "cta_url": "x", "avatar_id": 9},
            ["title_required", "cta_url_form", "avatar_missing"],
        ),
    ],
)
def test_rules(make, tables, changes, rules):
    assert broken(make, tables, **changes) == rules


def test_split_and_payload(make, tables):
    bad = {**GOOD, "request_id": 2, "title": ""}
    frame = make("video_requests", [[r[c] for c in COLUMNS] for r in (GOOD, bad)])
    checked = requests.validate(tables, frame)
    assert [r.request_id for r in requests.rejected(checked).collect()] == [2]
    (row,) = requests.payloads(checked).collect()
    payload = row.payload.asDict(recursive=True)
    assert (payload["transcript"], payload["title"]) == ("Hello", "T")
    assert payload["options"]["avatar"] == "actor-1"
    assert payload["options"]["scriptText"] == "Hello"
    assert payload["options"]["test"] is True and payload["options"]["scale"] == 1.0
    assert list(payload["options"])[-1] == "soundtrack"


def test_voices_of_an_avatar(tables):
    labels = {r.label for r in requests.voices_for(tables, 1).collect()}
    assert labels == {"English - Amy", "Welsh - Cat"}
    assert requests.voices_for(tables, 9).collect() == []
