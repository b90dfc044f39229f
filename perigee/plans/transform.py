"""Feed documents to asteroid and approach rows, and to record files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F

from ..functions.clock import instant
from ..functions.hazard import HAZARD_CLASSES
from ..functions.once import evaluate_once
from ..operators.shape import one_row
from ..sources import feed, listing
from ..sources.batches import pending
from ..sources.records import SUFFIX, transformed_name, write_records


def transform_feed(
    documents: DataFrame, at: dt.datetime | None = None, strict: bool = True
) -> DataFrame:
    """Records with nested approaches, one per listed object."""
    feeds = feed.valid_feeds(feed.decode_feed(documents), strict)
    return feed.records(feed.feed_objects(feeds), instant(at))


def transform_summary(
    documents: DataFrame, files: DataFrame, done: DataFrame, strict: bool = True
) -> DataFrame:
    """One row: files processed and skipped, objects listed, approaches, and classes.

    Objects are counted as listed, before duplicates are merged. Documents of files that are
    done are not parsed.
    """
    skipped = files.join(done.select("source_file").distinct(), "source_file", "left_semi")
    todo = pending(documents, done, "source_file")
    objects = feed.feed_objects(feed.valid_feeds(feed.decode_feed(todo), strict))
    neo = F.col("neo")
    own = feed.object_values(neo)
    classed = evaluate_once(
        objects.select("neo"),
        classes=F.transform(neo["close_approach_data"], lambda item: feed.hazard_of(own, feed.item_values(item))),
    )
    of_class = lambda name: F.sum(F.size(F.filter("classes", lambda held: held == name)))
    totals = classed.agg(
        F.count("*").alias("total_asteroids"),
        F.coalesce(F.sum(F.size("classes")), F.lit(0)).alias("total_approaches"),
        *[F.coalesce(of_class(name), F.lit(0)).alias(f"{name.lower()}_count") for name in HAZARD_CLASSES],
    )
    zero = F.lit(0).cast("bigint")
    counted = [
        files.agg(F.count("*").alias("n")).select(F.col("n").alias("files"), zero.alias("skipped")),
        skipped.agg(F.count("*").alias("n")).select(zero.alias("files"), F.col("n").alias("skipped")),
    ]
    sizes = counted[0].unionByName(counted[1]).agg(
        (F.sum("files") - F.sum("skipped")).alias("files_processed"),
        F.sum("skipped").alias("files_skipped"),
    )
    return one_row(sizes, totals)


def transformed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Source files (by raw name) that have output in `folder`; contents are not read."""
    if not listing.exists(spark, folder):
        return spark.createDataFrame([], "source_file string")
    raw = F.regexp_replace("source_file", r"_transformed\.json\z", ".json")
    return listing.files(spark, folder, lambda name: name.endswith(SUFFIX)).select(raw.alias("source_file")).distinct()


def plan_transform(spark: SparkSession, raw: str, out: str, force: bool = False) -> DataFrame:
    """Dry run: the files a transform would read, and where their output would go. A raw
    folder holds files of one document each, or batches as `land` writes them."""
    files = listing.files(spark, raw, lambda name: name.endswith(".json"))
    todo = pending(files, transformed_files(spark, out), "source_file", force)
    return todo.withColumn("output", transformed_name(F.col("source_file")))


def run_transform(
    spark: SparkSession,
    raw: str,
    out: str,
    at: dt.datetime | None = None,
    force: bool = False,
    strict: bool = True,
    rejects: str | None = None,
) -> DataFrame:
    """Transform the files that have no output yet; returns the files that were read, with
    the number of their documents that were rejected.

    Only those files are opened: the driver hands their paths, which its listing holds
    anyway, to the reader. A document without objects gets an output without records. The
    first bad document ends a strict run; else bad ones go, with the reason, to the folder
    `rejects`, which must then be given.

    Nothing decoded is kept: documents are decoded as they are written, and which files have
    bad ones is observed meanwhile. Only those files are read again, for their rejects.
    """
    if not strict and rejects is None:
        raise ValueError("name a folder for rejected documents")
    todo = plan_transform(spark, raw, out, force)
    held = todo.select("source_file", "path", "batch").collect()
    none = F.lit(0).cast("bigint").alias("rejected_documents")
    if not held:
        return todo.select("*", none)
    empty = listing.without_content(spark, todo.filter("NOT batch"), raw)
    empty = empty.select("source_file", F.lit("").alias("document"))
    fixed = at or dt.datetime.now(dt.timezone.utc)
    decoded = feed.decode_feed(_documents(spark, held).unionByName(empty))
    bad_files = Observation()
    if not strict:
        bad_file = F.when(F.col("decode_error").isNotNull(), F.col("source_file"))
        decoded = decoded.observe(bad_files, F.collect_set(bad_file).alias("names"))
    objects = feed.feed_objects(feed.valid_feeds(decoded, strict), keep_empty=True)
    write_records(feed.records(objects, instant(fixed)), out, overwrite=True)
    if strict:
        return todo.select("*", none)
    names = set(bad_files.get["names"])
    again = [row for row in held if row["source_file"] in names]
    rejected = empty.filter(F.col("source_file").isin(*names))
    if again:
        rejected = _documents(spark, again).unionByName(rejected)
    feed.rejects(feed.decode_feed(rejected)).write.mode("overwrite").parquet(rejects)
    bad = spark.read.parquet(rejects).groupBy("source_file").agg(F.count("*").alias("bad"))
    return todo.join(bad, "source_file", "left").select(
        *todo.columns, F.coalesce("bad", F.lit(0).cast("bigint")).alias("rejected_documents")
    )


def _documents(spark: SparkSession, held: list[Row]) -> DataFrame:
    """Documents of listed files, of one document each and of landed batches."""
    return feed.read_files(spark, [r["path"] for r in held if not r["batch"]], [r["path"] for r in held if r["batch"]])
