"""Splitting date ranges into extraction batches."""

from __future__ import annotations

import datetime as dt
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DEFAULT_BATCH_DAYS = 7
LONG_RANGE_DAYS = 365


def validate_range(start: dt.date, end: dt.date) -> None:
    """Refuse a reversed range; warn about a very long or a one-day one."""
    if start > end:
        raise ValueError("start date cannot be after end date")
    days = (end - start).days
    if days > LONG_RANGE_DAYS:
        warnings.warn(f"the range spans {days} days; consider smaller ones", stacklevel=2)
    if days == 0:
        warnings.warn("start and end are the same day", stacklevel=2)


def batch_file(start: Column, end: Column) -> Column:
    return F.concat(
        F.lit("asteroids_"),
        F.date_format(start, "yyyyMMdd"),
        F.lit("_"),
        F.date_format(end, "yyyyMMdd"),
        F.lit(".json"),
    )


def date_batches(
    ranges: DataFrame, start: str, end: str, batch_days: int = DEFAULT_BATCH_DAYS
) -> DataFrame:
    """Rows of `ranges` repeated per batch, numbered from 1; the last batch may be short.

    A reversed range has no batch.
    """
    if batch_days < 1:
        raise ValueError("batch_days must be at least 1")
    first, last = F.col(start), F.col(end)
    steps = F.sequence(F.lit(0), F.floor(F.date_diff(last, first) / F.lit(batch_days)).cast("int"))
    batches = ranges.filter(first <= last).select("*", F.explode(steps).alias("batch_step"))
    batch_start = F.date_add(first, F.col("batch_step") * F.lit(batch_days))
    return (
        batches.withColumn("batch_number", F.col("batch_step") + F.lit(1))
        .withColumn("batch_start", batch_start)
        .withColumn("batch_end", F.least(F.date_add("batch_start", batch_days - 1), last))
        .withColumn("batch_file", batch_file(F.col("batch_start"), F.col("batch_end")))
        .drop("batch_step")
    )


def plan_batches(
    spark: SparkSession, start: dt.date, end: dt.date, batch_days: int = DEFAULT_BATCH_DAYS
) -> DataFrame:
    """Batches of one requested range; nothing is fetched or written."""
    validate_range(start, end)
    one = spark.range(1).select(F.lit(start).alias("range_start"), F.lit(end).alias("range_end"))
    return date_batches(one, "range_start", "range_end", batch_days)


def batch_count(start: dt.date, end: dt.date, batch_days: int = DEFAULT_BATCH_DAYS) -> int:
    """Batches a range will need, as shown in a preview."""
    validate_range(start, end)
    return -(-((end - start).days + 1) // batch_days)


def pending(planned: DataFrame, existing: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Planned rows whose output is not there yet; all of them when forced.

    The names of files that are there go to every task. They are no more than a listing of the
    files, which a driver holds anyway; the planned rows may be whole documents, which a join
    by name would shuffle, and those of a large file into one task.
    """
    return planned if force else planned.join(F.broadcast(existing.select(key).distinct()), key, "left_anti")
