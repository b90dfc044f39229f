"""Landing feed documents in batches and describing the run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.clock import instant
from ..sources.batches import pending
from ..sources.feed import decode_feed, land, listed

# Fixed value: version of the feed interface, stored with every run.
FEED_API_VERSION = "v1"


def pending_batches(planned: DataFrame, landed: DataFrame, force: bool = False) -> DataFrame:
    """Batches still to fetch; `landed` names the files that are there (`batch_file`)."""
    return pending(planned, landed, "batch_file", force)


def batch_results(planned: DataFrame, landed: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per planned batch: `skipped` (landed before), `extracted` with its object
    count, or `failed` (no readable document came back), and how many documents of it could
    not be read. Documents of batches that are skipped are not parsed."""
    fresh = pending(documents, landed.select(F.col("batch_file").alias("source_file")), "source_file")
    decoded = decode_feed(fresh)
    readable = F.col("decode_error").isNull()
    counts = (
        decoded.groupBy(F.col("source_file").alias("batch_file"))
        .agg(
            F.sum(F.when(readable, listed(F.col("days")))).alias("objects"),
            F.count_if(~readable).alias("unreadable"),
        )
    )
    before = landed.select("batch_file").distinct().withColumn("landed", F.lit(True))
    joined = planned.join(before, "batch_file", "left").join(counts, "batch_file", "left")
    status = (
        F.when(F.col("landed"), "skipped")
        .when(F.col("objects").isNotNull(), "extracted")
        .otherwise("failed")
    )
    objects = F.when(status == "extracted", F.col("objects")).otherwise(F.lit(0))
    return joined.select(
        "batch_file",
        "batch_start",
        "batch_end",
        status.alias("status"),
        objects.cast("bigint").alias("objects"),
        F.coalesce("unreadable", F.lit(0)).alias("unreadable"),
    )


def extraction_summary(results: DataFrame) -> DataFrame:
    """One row over all batches. A batch that failed does not fail the run."""
    return results.agg(
        F.min("batch_start").alias("start_date"),
        F.max("batch_end").alias("end_date"),
        F.coalesce(F.sum("objects"), F.lit(0)).alias("total_asteroids"),
        F.count("*").alias("total_batches"),
        F.count_if(F.col("status") != "failed").alias("successful_batches"),
        F.count_if(F.col("status") == "failed").alias("failed_batches"),
    )


METADATA_VIEW = (
    "start_date",
    "end_date",
    "extracted_at",
    "total_asteroids",
    "total_batches",
    "nasa_api_version",
)


def describe(summary: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    """The summary with dates as text, the time of the run and the feed version."""
    stamp = F.date_format(instant(at), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return (
        summary.withColumn("start_date", F.col("start_date").cast("string"))
        .withColumn("end_date", F.col("end_date").cast("string"))
        .withColumn("extracted_at", stamp)
        .withColumn("nasa_api_version", F.lit(FEED_API_VERSION))
    )


def extraction_metadata(results: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    """What is stored beside the landed files."""
    return describe(extraction_summary(results), at).select(*METADATA_VIEW)


def land_batches(
    planned: DataFrame,
    landed: DataFrame,
    documents: DataFrame,
    folder: str,
    metadata_folder: str,
    force: bool = False,
    at: dt.datetime | None = None,
) -> DataFrame:
    """Land the documents of pending batches and the metadata; returns the batch results.

    `documents` has `source_file`, named as the batch file, and `document`.
    """
    todo = pending_batches(planned, landed, force)
    dated = documents.join(
        todo.select(F.col("batch_file").alias("source_file"), "batch_start", "batch_end"),
        "source_file",
    )
    known = landed.limit(0) if force else landed
    results = batch_results(planned, known, dated)
    # described first: landing adds the files that `landed` may list
    extraction_metadata(results, at).write.mode("overwrite").json(metadata_folder)
    land(dated, folder, overwrite=True)
    return results
