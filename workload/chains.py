"""Registered queries that write files to the session's shared folder and read them back."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from perigee.operators import telemetry
from perigee.plans import load, transform
from perigee.sources import batches, feed, records, tables
from perigee.streaming import telemetry as live
from perigee.streaming.loading import load_stream

from . import mapping as m

#: Days of a batch; a batch whose answers broke off, and one in which nothing was listed.
BATCH_DAYS, FIRST_DAY = 91, dt.date(1995, 1, 1)
BROKEN, BARE = "asteroids_19971228_19980328.json", "asteroids_19980329_19980627.json"
NOTHING = '{"links":{"self":"feed"},"element_count":0,"near_earth_objects":{}}'


def scratch(spark: SparkSession) -> str:
    """A fresh folder where all executors see it. Only a local session that names no shared
    folder, as in tests, gets one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="perigee-")
    return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"


def batched_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Lean documents in the files of their batches, with the days of these."""
    documents = m.feed_documents(spark, folder, lean=True)
    day = F.to_date(F.substring("source_file", 11, 8), "yyyyMMdd")
    start = F.date_sub(day, F.date_diff(day, F.lit(FIRST_DAY)) % F.lit(BATCH_DAYS))
    dated = documents.select("document", start.alias("batch_start"), F.date_add(start, BATCH_DAYS - 1).alias("batch_end"))
    return dated.withColumn("source_file", batches.batch_file(F.col("batch_start"), F.col("batch_end")))


def landing_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Per batch what comes back of the landed documents."""
    place = scratch(spark)
    feed.land(batched_documents(spark, folder), place)
    read = feed.read_landed(spark, place)
    counts = feed.object_counts(feed.valid_feeds(feed.decode_feed(read)))
    return counts.groupBy("source_file").agg(
        F.count("*").alias("documents"), F.sum("actual_count").alias("objects"), F.count_if("consistent").alias("consistent")
    )


def landed_range(spark: SparkSession, folder: str) -> DataFrame:
    """Objects of a range of days, read from the batch folders that touch it only."""
    place = scratch(spark)
    feed.land(batched_documents(spark, folder), place)
    first, last = m.AS_OF.date().replace(year=1998, month=1, day=1), m.AS_OF.date().replace(year=1998, month=6, day=30)
    read = feed.read_landed(spark, place, first, last)
    objects = feed.feed_objects(feed.valid_feeds(feed.decode_feed(read)), first, last)
    return objects.groupBy("feed_date").agg(F.count("*").alias("objects"))


def file_chain(spark: SparkSession, folder: str) -> DataFrame:
    """From landed documents to tables: what the dry runs announce for each file, what becomes
    of it, and what the ledger says. Broken documents are rejected, files without objects fail,
    and all others are loaded."""
    place = scratch(spark)
    raw, lines, root = (f"{place}/{name}" for name in ("raw", "records", "tables"))
    name, document = F.col("source_file"), F.col("document")
    damaged = F.when(name == BROKEN, F.substring("document", 1, 40)).when(name == BARE, F.lit(NOTHING))
    feed.land(batched_documents(spark, folder).withColumn("document", F.coalesce(damaged, document)), raw)

    planned = transform.plan_transform(spark, raw, lines).select("source_file", "output").distinct()
    done = transform.run_transform(spark, raw, lines, m.AS_OF, strict=False, rejects=f"{place}/rejects")
    rejected = done.groupBy("source_file").agg(F.max("rejected_documents").alias("rejected_documents"))
    announced = load.plan_load(spark, lines, root).select(F.col("source_file").alias("output")).distinct()
    load.run_load(spark, lines, root, at=m.AS_OF)
    left = load.plan_load(spark, lines, root).select(F.col("source_file").alias("output")).distinct()
    book = tables.read_table(spark, root, "etl_events").withColumnRenamed("source_file", "output")
    return (
        planned.join(rejected, "source_file")
        .join(announced.withColumn("announced", F.lit(True)), "output", "left")
        .join(left.withColumn("pending", F.lit(True)), "output", "left")
        .join(book, "output", "left")
        .select(
            "source_file", "rejected_documents", F.coalesce("announced", F.lit(False)).alias("announced"),
            F.coalesce("pending", F.lit(False)).alias("pending"), "status", "asteroids_processed",
            "approaches_processed", "error_message",
        )
    )


def streamed_load(spark: SparkSession, folder: str) -> DataFrame:
    """The stored approaches by day, after all record files came in as a stream."""
    place = scratch(spark)
    lines, root = f"{place}/records", f"{place}/tables"
    records.write_records(transform.transform_feed(batched_documents(spark, folder), m.AS_OF), lines)
    load_stream(spark, lines, root, f"{place}/checkpoint").awaitTermination()
    held = tables.read_table(spark, root, "approaches")
    return held.groupBy("close_approach_date").agg(
        F.count("*").alias("approaches"), F.count_distinct("asteroid_id").alias("asteroids")
    )


def streamed_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of a log that came in as a stream, half of its days closed."""
    place = scratch(spark)
    events = m.table(spark, folder, "events")
    log = m.requests_of(live.log_stream(spark, folder, events.schema, "events.parquet"))
    live.add_up(log, telemetry.http_minutes, f"{place}/minutes", f"{place}/checkpoint").awaitTermination()
    day = F.to_date(F.timestamp_seconds(F.avg(F.unix_timestamp(F.col("ts").cast("timestamp")))))
    live.close_days(spark, f"{place}/minutes", events.agg(day.alias("day")).first()["day"])
    rates = live.http_rates(spark, f"{place}/minutes")
    return rates.withColumn("avg_response_time_ms", F.round("avg_response_time_ms", 6))
