"""Loading record files into the tables, once per file."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.clock import instant
from ..operators import ledger, merge
from ..operators.shape import one_row
from ..sources import listing, records, tables

# which of several copies counts: the asteroid written last, the approach written first
LATEST = ["updated_at", "source_file"]
EARLIEST = ["created_at", "source_file"]


def file_stats(
    files: DataFrame, asteroids: DataFrame, approaches: DataFrame, added: DataFrame
) -> DataFrame:
    """Per file: distinct objects, approaches added and skipped, and whether it failed.

    An added approach is credited to the file it was taken from. A file of `files` without
    any object had no valid record and failed.
    """
    zero = F.lit(0).cast("bigint")

    def part(frame: DataFrame, column: str) -> DataFrame:
        counts = {"objects": zero, "rows": zero, "added": zero, column: F.col("n")}
        return frame.groupBy("source_file").agg(F.count("*").alias("n")).select(
            "source_file", *[value.alias(name) for name, value in counts.items()]
        )

    empty = files.select(
        "source_file", zero.alias("objects"), zero.alias("rows"), zero.alias("added")
    )
    objects = asteroids.select("source_file", "neo_reference_id").distinct()
    together = (
        empty.unionByName(part(objects, "objects"))
        .unionByName(part(approaches, "rows"))
        .unionByName(part(added, "added"))
    )
    return _file_totals(together)


def _file_totals(parts: DataFrame) -> DataFrame:
    """Per file the sums of `objects`, `rows` and `added`; a file without any object failed."""
    summed = parts.groupBy("source_file").agg(
        F.sum("objects").alias("asteroids_upserted"),
        F.sum("added").alias("approaches_inserted"),
        (F.sum("rows") - F.sum("added")).alias("approaches_skipped"),
    )
    return summed.withColumn("failed", F.col("asteroids_upserted") == 0)


def counted_load(files: DataFrame, keys: DataFrame, approaches: DataFrame) -> DataFrame:
    """`file_stats` of a load that is only counted, from the keys of what comes in
    (`feed.merge_keys`), which are read once.

    Every row counts in groups of three kinds, made in one aggregation: the key of an
    approach, an object of a file, and a file. A group of the first kind keeps the first file
    by name, which is credited, and whether the key is stored already; however many files
    list a key, that is all there is of it.
    """
    text, instant, flag = (F.lit(None).cast(kind) for kind in ("string", "bigint", "boolean"))

    def group(kind: str, asteroid: Column = text, epoch: Column = instant, file: Column = text) -> Column:
        return F.struct(F.lit(kind).alias("kind"), asteroid.alias("asteroid_id"), epoch.alias("epoch"), file.alias("file"))

    source, asteroid, epoch = F.col("source_file"), F.col("asteroid_id"), F.col("epoch")
    groups = F.when(epoch.isNull(), F.array(group("object", asteroid, file=source))).otherwise(
        F.array(group("approach", asteroid, epoch), group("file", file=source))
    )
    incoming = keys.select(source.alias("lister"), flag.alias("stored"), F.inline(groups))
    stored = approaches.select(
        text.alias("lister"), F.lit(True).alias("stored"),
        F.inline(F.array(group("approach", asteroid, F.col("epoch_date_close_approach")))),
    )
    each = incoming.unionByName(stored).groupBy("kind", "asteroid_id", "epoch", "file").agg(
        F.min("lister").alias("first"), F.max("stored").alias("stored"), F.count("lister").alias("n")
    )
    kind = F.col("kind")
    of = lambda name, value: F.when(kind == name, value).otherwise(F.lit(0)).cast("bigint")
    counted = each.filter(F.col("first").isNotNull()).select(
        F.coalesce("file", "first").alias("source_file"),
        of("object", F.lit(1)).alias("objects"),
        of("file", F.col("n")).alias("rows"),
        of("approach", F.when(F.col("stored"), 0).otherwise(1)).alias("added"),
    )
    zero = F.lit(0).cast("bigint")
    listed = files.select("source_file", zero.alias("objects"), zero.alias("rows"), zero.alias("added"))
    return _file_totals(counted.unionByName(listed))


def load_summary(stats: DataFrame, skipped_files: DataFrame) -> DataFrame:
    """One row over all files of a load; failed files count nowhere."""
    done = stats.filter(~F.col("failed")).agg(
        F.count("*").alias("files_processed"),
        F.coalesce(F.sum("asteroids_upserted"), F.lit(0)).alias("asteroids_upserted"),
        F.coalesce(F.sum("approaches_inserted"), F.lit(0)).alias("approaches_inserted"),
        F.coalesce(F.sum("approaches_skipped"), F.lit(0)).alias("approaches_skipped"),
    )
    skipped = skipped_files.agg(F.count("*").alias("files_skipped"))
    return one_row(done, skipped).select(
        "files_processed",
        "files_skipped",
        "asteroids_upserted",
        "approaches_inserted",
        "approaches_skipped",
    )


def file_events(stats: DataFrame, at: dt.datetime) -> DataFrame:
    """Ledger events of a load: every file starts, then completes or fails."""
    failed = F.col("failed")
    start = F.struct(
        F.lit("start").alias("kind"),
        F.lit(0).alias("sequence"),
        F.lit(None).cast("int").alias("asteroids"),
        F.lit(None).cast("int").alias("approaches"),
        F.lit(None).cast("string").alias("message"),
    )
    end = F.struct(
        F.when(failed, F.lit("fail")).otherwise(F.lit("complete")).alias("kind"),
        F.lit(1).alias("sequence"),
        F.when(~failed, F.col("asteroids_upserted").cast("int")).alias("asteroids"),
        F.when(~failed, F.col("approaches_inserted").cast("int")).alias("approaches"),
        F.when(failed, F.lit("No valid records found in file")).alias("message"),
    )
    return stats.select(
        "source_file", instant(at).alias("at"), F.inline(F.array(start, end))
    )


def plan_load(spark: SparkSession, folder: str, root: str, force: bool = False) -> DataFrame:
    """Dry run: the files a load would read."""
    listed = records.record_files(spark, folder)
    return ledger.pending_files(listed, tables.read_table(spark, root, "etl_events"), force)


def run_load(
    spark: SparkSession,
    folder: str,
    root: str,
    force: bool = False,
    at: dt.datetime | None = None,
) -> DataFrame | None:
    """Load the files that were not completed before; returns the summary, or None if there
    was nothing to do. Files fail one by one; the others are loaded."""
    at = at or dt.datetime.now(dt.timezone.utc)
    listed, known = records.record_files(spark, folder), tables.read_table(spark, root, "etl_events")
    todo = ledger.pending_files(listed, known, force)
    # the driver hands the reader paths that its file listing holds anyway
    paths = [row["path"] for row in todo.select("path").collect()]
    if not paths:
        return None
    files = todo.select("source_file").distinct()
    lines = spark.read.text(paths).select(records.line_source().alias("source_file"), "value")
    done = ledger.completed_files(listed.select("source_file").distinct(), known)
    skipped = done.limit(0) if force else done
    return commit(spark, root, files, lines, skipped, at)


def commit(
    spark: SparkSession,
    root: str,
    files: DataFrame,
    lines: DataFrame,
    skipped: DataFrame,
    at: dt.datetime,
) -> DataFrame:
    """Merge the lines of `files` with the stored tables and write these, parents before
    children, the ledger last.

    The decoded lines and the added approaches are each used several times and are written down
    meanwhile, compressed and by column, beside the tables: kept frames would hold them several
    times as large on the executors. What is counted is written down before the tables change,
    so that it cannot be counted anew after that.
    """
    asteroids, approaches, book = (tables.read_table(spark, root, name) for name in ("asteroids", "approaches", "etl_events"))
    try:
        decoded = _written(records.decode_records(lines).filter(F.col("state") == "valid"), f"{root}/_decoded")
        objects, events = records.record_asteroids(decoded), records.record_approaches(decoded)
        added = _written(
            merge.new_approaches(tables.met(approaches, "approaches", events), events, EARLIEST), f"{root}/_added"
        )
        stats = _written(file_stats(files, objects, events, added), f"{root}/_counted")
        summary = load_summary(stats, skipped)
        row = summary.first()
        tables.rewrite(merge.upsert_asteroids(tables.met(asteroids, "asteroids", objects), objects, LATEST), root, "asteroids")
        tables.append(added, root, "approaches")
        changes = ledger.fold_events(file_events(stats, at))
        tables.rewrite(ledger.apply_events(tables.met(book, "etl_events", stats), changes), root, "etl_events")
        return spark.createDataFrame([row], summary.schema)
    finally:
        for name in ("_decoded", "_added"):
            listing.remove(spark, f"{root}/{name}")


def _written(rows: DataFrame, place: str) -> DataFrame:
    """The rows, written to a folder of their own and read from there."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def delete_asteroids(spark: SparkSession, root: str, removed: DataFrame) -> None:
    """Remove asteroids (column `id`) with all that hangs on them, children first, so that a
    delete that ended half way leaves no orphans and can be repeated."""
    gone = removed.select("id").distinct()
    parent = gone.withColumnRenamed("id", "asteroid_id")
    approaches = tables.read_table(spark, root, "approaches").join(parent, "asteroid_id", "left_semi")
    tables.delete(spark, root, "alerts", "approach_id", approaches.select(F.col("id").alias("approach_id")))
    tables.delete(spark, root, "approaches", "asteroid_id", parent)
    tables.delete(spark, root, "asteroids", "id", gone)
