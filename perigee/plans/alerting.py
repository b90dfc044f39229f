"""From candidates to an outbox, and from deliveries to the record."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..operators import alerts
from ..sources import tables


def write_outbox(
    spark: SparkSession,
    root: str,
    folder: str,
    as_of: dt.date | None = None,
    channel: str = alerts.CHANNEL,
    limit: int | None = alerts.BATCH,
) -> DataFrame:
    """Write the messages of the next candidates; returns them. A sender that stops half
    way sends the rest in the next run, because only recorded deliveries leave the list."""
    candidates = alerts.alert_candidates(
        tables.read_table(spark, root, "approaches"),
        tables.read_table(spark, root, "asteroids"),
        tables.read_table(spark, root, "alerts"),
        as_of,
        channel,
        limit,
    )
    alerts.outbox(candidates, channel).write.mode("errorifexists").parquet(folder)
    return spark.read.parquet(folder)


def record_deliveries(
    spark: SparkSession, root: str, delivered: DataFrame, at: dt.datetime | None = None
) -> None:
    """Record messages (`approach_id`, `alert_type`) a sender has delivered."""
    known = tables.met(tables.read_table(spark, root, "alerts"), "alerts", delivered)
    fresh = alerts.record_alerts(known, delivered, at or dt.datetime.now(dt.timezone.utc))
    tables.append(fresh, root, "alerts")
