"""Choosing approaches to alert about, their messages, and the record of what was sent."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions import display
from ..functions.clock import day, instant
from ..functions.ids import alert_id
from ..sources.tables import in_months
from .merge import ALERT_KEY, insert_ignoring

# The channel, the classes that are alerted, and what is stored when sent.
CHANNEL = "discord"
ALERTED_CLASSES = ("Hazardous", "High", "Critical")
SENT_PAYLOAD = '{"status":"sent"}'
BATCH = 100

# The columns of a candidate.
CANDIDATE_VIEW = (
    "approach_id",
    "name",
    "neo_reference_id",
    "close_approach_date",
    "miss_distance_km",
    "velocity_km_per_h",
    "hazard_classification",
    "estimated_diameter_avg_km",
)


def not_alerted(approaches: DataFrame, alerts: DataFrame, channel: str = CHANNEL) -> DataFrame:
    """Approaches without an alert on this channel; alerts elsewhere do not count."""
    sent = alerts.filter(F.col("alert_type") == channel).select(F.col("approach_id").alias("id"))
    return approaches.join(sent, "id", "left_anti").select(*approaches.columns)


def alert_candidates(
    approaches: DataFrame,
    asteroids: DataFrame,
    alerts: DataFrame,
    as_of: dt.date | None = None,
    channel: str = CHANNEL,
    limit: int | None = BATCH,
) -> DataFrame:
    """The next approaches to alert about, soonest first; all of them if `limit` is None.

    The date goes first, because it reaches the scan and leaves the least to join.
    """
    upcoming = in_months(approaches, day(as_of), None).filter(F.col("close_approach_date") >= day(as_of))
    objects = asteroids.select(
        F.col("id").alias("asteroid_id"),
        "name",
        "neo_reference_id",
        "is_potentially_hazardous",
        "estimated_diameter_avg_km",
    )
    eligible = upcoming.join(objects, "asteroid_id").filter(
        F.col("is_potentially_hazardous") | F.col("hazard_classification").isin(*ALERTED_CLASSES)
    )
    fresh = not_alerted(eligible, alerts, channel).withColumnRenamed("id", "approach_id")
    ordered = fresh.orderBy("close_approach_date", "approach_id")
    return (ordered if limit is None else ordered.limit(limit)).select(*CANDIDATE_VIEW)


def alert_messages(candidates: DataFrame) -> DataFrame:
    """One message per candidate, as JSON text."""
    message = display.alert_document(
        F.col("name"),
        F.col("hazard_classification"),
        F.col("close_approach_date"),
        F.col("miss_distance_km"),
        F.col("velocity_km_per_h"),
        F.col("estimated_diameter_avg_km"),
    )
    return candidates.select("approach_id", message.alias("message"))


def alert_fields(candidates: DataFrame) -> DataFrame:
    """The formatted parts of the messages."""
    return candidates.select(
        "approach_id",
        display.miss_distance_text(F.col("miss_distance_km")).alias("miss_text"),
        display.velocity_text(F.col("velocity_km_per_h")).alias("velocity_text"),
        display.diameter_text(F.col("estimated_diameter_avg_km")).alias("diameter_text"),
        display.hazard_colour(F.col("hazard_classification")).alias("colour"),
    )


def outbox(candidates: DataFrame, channel: str = CHANNEL) -> DataFrame:
    """Messages waiting for a sender; nothing counts as sent until it is recorded."""
    return alert_messages(candidates).select(
        "approach_id",
        F.lit(channel).alias("alert_type"),
        "message",
        F.lit(False).alias("delivered"),
    )


def record_alerts(
    alerts: DataFrame, sent: DataFrame, at: dt.datetime | None = None
) -> DataFrame:
    """Rows to append for delivered messages (`approach_id`, `alert_type`).

    A message delivered twice, or recorded before, adds nothing.
    """
    once = sent.select(*ALERT_KEY).distinct()
    return insert_ignoring(alerts, once, ALERT_KEY).select(
        alert_id(F.col("approach_id"), F.col("alert_type")).alias("id"),
        "approach_id",
        "alert_type",
        instant(at).alias("alerted_at"),
        F.lit(SENT_PAYLOAD).alias("payload"),
    )
