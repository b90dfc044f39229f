"""Counters, histograms and one-minute rates over request and query logs.

The same functions serve batch frames and streams. Everything is counted per label set
before it is unfolded into rows, so a hot label set costs one row per task in the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import display
from ..functions.clock import instant
from .reads import dashboard_stats, last_run
from .shape import one_row

# Labels and histogram limits in seconds.
HTTP_LABELS = ["method", "path", "status"]
HTTP_BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
DB_LABELS = ["operation", "status"]
DB_BUCKETS = [0.0001, 0.0005, 0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]

RATE_SECONDS = 60


def counter(log: DataFrame, labels: list[str]) -> DataFrame:
    return log.groupBy(*labels).agg(F.count("*").alias("total"))


def histogram(log: DataFrame, labels: list[str], limits: list[float]) -> DataFrame:
    """Cumulative buckets per label set; the last limit is `+Inf` and counts every row."""
    inside = [
        F.count_if((F.col("duration_s") <= F.lit(limit)) & ~F.isnan("duration_s")).alias(f"le_{i}")
        for i, limit in enumerate(limits)
    ]
    counted = log.groupBy(*labels).agg(
        *inside, F.count("*").alias("count"), F.sum("duration_s").alias("sum_s")
    )
    buckets = [
        F.struct(F.lit(str(limit)).alias("le"), F.col(f"le_{i}").alias("bucket_count"))
        for i, limit in enumerate(limits)
    ]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
    return counted.select(*labels, F.inline(F.array(*buckets)), "count", "sum_s")


def is_error(status: Column) -> Column:
    """Client and server errors, 400 to 599."""
    return status.between(400, 599)


def _minute() -> Column:
    return F.window("ts", f"{RATE_SECONDS} seconds")


def _http_parts() -> list[Column]:
    return [
        F.count("*").alias("requests"),
        F.count_if(is_error(F.col("status"))).alias("errors"),
        F.sum("duration_s").alias("seconds"),
    ]


def _http_rates() -> list[Column]:
    requests = F.col("requests")
    some = F.nullif(requests, F.lit(0))
    return [
        (requests / F.lit(RATE_SECONDS)).alias("requests_per_second"),
        (F.col("errors") / some * F.lit(100)).alias("error_rate_percent"),
        (F.col("seconds") / some * F.lit(1000)).alias("avg_response_time_ms"),
    ]


def _per_minute(log: DataFrame, *parts: Column) -> DataFrame:
    counted = log.groupBy(_minute().alias("minute")).agg(*parts)
    return counted.select(F.col("minute.start").alias("window_start"), *counted.columns[1:])


def http_minutes(log: DataFrame) -> DataFrame:
    """What the request rates of an aligned minute are made of: sums, which can be added up."""
    return _per_minute(log, *_http_parts())


def db_minutes(log: DataFrame) -> DataFrame:
    return _per_minute(log, F.count("*").alias("queries"))


def added_minutes(minutes: DataFrame) -> DataFrame:
    """Sums of the same minute, from several parts of a log, as one row."""
    parts = [F.sum(name).alias(name) for name in minutes.columns if name != "window_start"]
    return minutes.groupBy("window_start").agg(*parts)


def http_rates_of(minutes: DataFrame) -> DataFrame:
    return minutes.select("window_start", *_http_rates())


def db_rates_of(minutes: DataFrame) -> DataFrame:
    rate = F.col("queries") / F.lit(RATE_SECONDS)
    return minutes.select("window_start", rate.alias("db_queries_per_second"))


def http_rates(log: DataFrame) -> DataFrame:
    """Request rate, error share and mean response time per aligned minute."""
    return http_rates_of(http_minutes(log))


def db_rates(log: DataFrame) -> DataFrame:
    """Query rate per aligned minute."""
    return db_rates_of(db_minutes(log))


def _last_minute(log: DataFrame, as_of: dt.datetime | None) -> DataFrame:
    now = instant(as_of)
    start = now - F.expr(f"INTERVAL {RATE_SECONDS} SECONDS")
    return log.filter((F.col("ts") > start) & (F.col("ts") <= now))


def metrics_summary(
    requests: DataFrame,
    queries: DataFrame,
    asteroids: DataFrame,
    approaches: DataFrame,
    runs: DataFrame,
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """Rates of the minute before `as_of`, table counts and the last load, in one row.

    Rates of a minute without traffic are 0.
    """
    http = _last_minute(requests, as_of).agg(*_http_parts()).select(*_http_rates())
    database = _last_minute(queries, as_of).agg(
        (F.count("*") / F.lit(RATE_SECONDS)).alias("db_queries_per_second")
    )
    merged = one_row(http, database, dashboard_stats(asteroids, approaches), last_run(runs))
    rates = (
        "requests_per_second",
        "error_rate_percent",
        "avg_response_time_ms",
        "db_queries_per_second",
    )
    return merged.select(
        *[F.coalesce(F.col(name), F.lit(0.0)).alias(name) for name in rates],
        "total_asteroids",
        "total_approaches",
        "hazardous_count",
        "last_etl_run",
    )


def metric_texts(summary: DataFrame) -> DataFrame:
    """The rates as shown, with the class of the error rate."""
    text = lambda name, unit="": F.concat(display.rate_text(F.col(name)), F.lit(unit)).alias(name)
    return summary.select(
        text("requests_per_second"),
        text("error_rate_percent", "%"),
        display.error_rate_class(F.col("error_rate_percent")).alias("error_rate_class"),
        text("avg_response_time_ms", " ms"),
        text("db_queries_per_second"),
    )
