"""Telemetry over live logs, with the functions of the batch side."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import telemetry
from ..sources.listing import remove

#: Partitions of kept sums, the batch number of a closed day, and the last batch it holds.
DAY, BATCH, CLOSED, UPTO = "day", "batch", -1, "upto"


def log_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet") -> DataFrame:
    """A log folder as a stream; `ts` must be a timestamp."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def live_request_totals(log: DataFrame) -> DataFrame:
    """Counters since the start of the stream; state is one row per label set."""
    return telemetry.counter(log, telemetry.HTTP_LABELS)


def live_query_totals(log: DataFrame) -> DataFrame:
    return telemetry.counter(log, telemetry.DB_LABELS)


def live_request_histogram(log: DataFrame) -> DataFrame:
    return telemetry.histogram(log, telemetry.HTTP_LABELS, telemetry.HTTP_BUCKETS)


def live_query_histogram(log: DataFrame) -> DataFrame:
    return telemetry.histogram(log, telemetry.DB_LABELS, telemetry.DB_BUCKETS)


def add_up(
    log: DataFrame,
    minutes: Callable[[DataFrame], DataFrame],
    folder: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Per-minute sums of each batch of a log, kept in `folder` by day and batch.

    No event is too late and no minute waits to be closed: a batch adds what it has to its
    minutes, and the rates add up the batches. A repeated batch replaces its own partitions.
    `minutes` is `telemetry.http_minutes` or `telemetry.db_minutes`.
    """

    def write(batch: DataFrame, number: int) -> None:
        _keep(minutes(batch), F.lit(None), number, folder)

    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _keep(minutes: DataFrame, upto: Column, batch: int, folder: str) -> None:
    rows = minutes.select("*", upto.cast("bigint").alias(UPTO), F.to_date("window_start").alias(DAY), F.lit(batch).cast("bigint").alias(BATCH))
    writer = rows.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(DAY, BATCH).parquet(folder)


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that count: of a closed day its sums and the batches that came after them."""
    rows = spark.read.parquet(folder)
    closed = rows.filter(F.col(BATCH) == CLOSED).groupBy(DAY).agg(F.max(UPTO).alias("last"))
    return rows.join(closed, DAY, "left").filter(
        (F.col(BATCH) == CLOSED) | F.col("last").isNull() | (F.col(BATCH) > F.col("last"))
    )


def close_days(spark: SparkSession, folder: str, before: dt.date) -> None:
    """Sum up the batches of the days before a date: of each such day one partition is left,
    however many batches it had. Late batches still count, and are taken in the next time.

    The sums say up to which batch they go, and what they hold is not read beside them; so
    it does not matter where a closing ends early, nor whether it is repeated.
    """
    past = _counted(spark, folder).filter(F.col(DAY) < F.lit(before))
    days = past.groupBy(DAY).agg(
        F.max(F.greatest(BATCH, F.coalesce(UPTO, F.lit(CLOSED)))).alias("newest"), F.max(BATCH).alias("open")
    ).collect()
    newest = {row[DAY]: row["newest"] for row in days}
    fresh = {row[DAY]: row["newest"] for row in days if row["open"] != CLOSED}
    if fresh:
        rows = past.filter(F.col(DAY).isin(list(fresh))).drop(DAY, BATCH, UPTO, "last")
        upto = F.create_map(*[F.lit(x) for pair in fresh.items() for x in pair])[F.to_date("window_start")]
        _keep(telemetry.added_minutes(rows), upto, CLOSED, folder)
    done = spark.read.parquet(folder).select(DAY, BATCH).filter(F.col(DAY) < F.lit(before)).distinct()
    for row in done.filter(F.col(BATCH) != CLOSED).collect():
        if row[BATCH] <= newest.get(row[DAY], CLOSED):
            remove(spark, f"{folder}/{DAY}={row[DAY]}/{BATCH}={row[BATCH]}")


def _minutes(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.added_minutes(_counted(spark, folder).drop(DAY, BATCH, UPTO, "last"))


def http_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of all minutes so far, the running one included."""
    return telemetry.http_rates_of(_minutes(spark, folder))


def db_rates(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.db_rates_of(_minutes(spark, folder))


def replace_with(
    totals: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hand the whole current state to `write` after every batch."""
    return (
        totals.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
