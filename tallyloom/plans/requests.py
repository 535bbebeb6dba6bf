"""Video requests: rule checks, avatar look-up, voices and the nested payload."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.fixed_values import (
    ALIGNMENTS,
    BACKGROUNDS,
    LONG_MATCH_MODES,
    MAX_DESCRIPTION,
    MAX_TITLE,
    MAX_TRANSCRIPT,
    PAYLOAD_BACKGROUND_COLOR,
    PAYLOAD_SCALE,
    SHORT_MATCH_MODES,
    STYLES,
    URL_PATTERN,
)

Tables = Mapping[str, DataFrame]

REQUIRED = (
    "title",
    "description",
    "transcript",
    "cta_label",
    "cta_url",
    "horizontal_align",
    "style",
    "voice",
    "sound_track",
    "background",
    "short_content_match_mode",
    "long_content_match_mode",
)

LENGTH_LIMITS = {
    "title": MAX_TITLE,
    "description": MAX_DESCRIPTION,
    "transcript": MAX_TRANSCRIPT,
}

CLOSED_LISTS = {
    "horizontal_align": ALIGNMENTS,
    "style": STYLES,
    "background": BACKGROUNDS,
    "short_content_match_mode": SHORT_MATCH_MODES,
    "long_content_match_mode": LONG_MATCH_MODES,
}


def _rules() -> dict[str, Column]:
    """Rule name -> broken. Only the required rules speak about an empty field."""
    filled = {name: F.coalesce(F.col(name), F.lit("")) != "" for name in REQUIRED}
    rules = {f"{name}_required": ~filled[name] for name in REQUIRED}
    for name, limit in LENGTH_LIMITS.items():
        rules[f"{name}_length"] = F.char_length(F.col(name)) > limit
    rules["cta_url_form"] = filled["cta_url"] & ~F.col("cta_url").rlike(URL_PATTERN)
    rules["circular_align"] = (
        (F.col("style") == "circular")
        & filled["horizontal_align"]
        & (F.col("horizontal_align") != "none")
    )
    for name, allowed in CLOSED_LISTS.items():
        rules[f"{name}_listed"] = filled[name] & ~F.col(name).isin(allowed)
    return rules


def with_avatar(tables: Tables, requests: DataFrame) -> DataFrame:
    """Requests with the actor of their avatar, NULL where there is no such avatar."""
    avatars = tables["avatars"].select(F.col("id").alias("avatar_id"), "actor_id")
    return requests.join(avatars, "avatar_id", "left")


def validate(tables: Tables, requests: DataFrame) -> DataFrame:
    """Requests with ``actor_id`` and ``broken``, the names of all rules they break, in order."""
    rules = {**_rules(), "avatar_missing": F.col("actor_id").isNull()}
    names = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return with_avatar(tables, requests).withColumn("broken", F.array_compact(names))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("broken") == 0)


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("broken") > 0)


def payloads(validated: DataFrame) -> DataFrame:
    """The nested request of every accepted row, as a struct."""
    options = F.struct(
        F.lit(True).alias("test"),
        "title",
        "description",
        F.col("cta_label").alias("label"),
        F.col("cta_url").alias("url"),
        F.col("transcript").alias("scriptText"),
        F.col("actor_id").alias("avatar"),
        "voice",
        F.col("horizontal_align").alias("horizontalAlign"),
        F.lit(PAYLOAD_SCALE).alias("scale"),
        "style",
        F.lit(PAYLOAD_BACKGROUND_COLOR).alias("backgroundColor"),
        F.lit(False).alias("seamless"),
        "background",
        F.col("short_content_match_mode").alias("shortBackgroundContentMatchMode"),
        F.col("long_content_match_mode").alias("longBackgroundContentMatchMode"),
        F.col("sound_track").alias("soundtrack"),
    )
    return accepted(validated).select(
        "request_id", F.struct("transcript", "title", options.alias("options")).alias("payload")
    )


def voices_for(tables: Tables, avatar_id: int) -> DataFrame:
    """Voices offered for an avatar: those of its gender, with their label."""
    avatar = tables["avatars"].filter(F.col("id") == avatar_id).orderBy("id").limit(1)
    label = F.concat(F.col("language"), F.lit(" - "), F.col("name"))
    return (
        tables["voices"]
        .filter(F.col("gender") == avatar.select("gender").scalar())
        .withColumn("label", label)
    )
