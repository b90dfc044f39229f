"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

UTC_CONF = "spark.sql.session.timeZone"


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC dates and adaptive execution; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app).config(UTC_CONF, "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """The same for a session built elsewhere: dates here are UTC calendar days, whatever
    zone the session came with."""
    if spark.conf.get(UTC_CONF) != "UTC":
        spark.conf.set(UTC_CONF, "UTC")
