"""Record files as a stream: every file is loaded exactly once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ledger
from ..plans.load import commit
from ..sources import tables
from ..sources.listing import without_content
from ..sources.records import SUFFIX, line_source, record_files


def record_stream(
    spark: SparkSession, folder: str, files_per_batch: int | None = None
) -> DataFrame:
    """Lines of new record files with their source file, from flat folders and from those that
    a transform writes; a file is never split over batches."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(folder).select(line_source().alias("source_file"), "value")
    return lines.filter(F.col("source_file").endswith(SUFFIX))


def load_stream(
    spark: SparkSession,
    folder: str,
    root: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Load what is there now and stop. The checkpoint remembers the files. Files without any
    content, which no stream returns, are recorded first. It is an error if the folder has
    files and none is a record file.

    A batch that is repeated after a failure changes nothing that it wrote before: files that
    the ledger has as completed are left out, and others merge to the same rows. A batch reads
    the partitions it has keys for, however many batches came before it.
    """
    tables.ensure_tables(spark, root)
    listed = record_files(spark, folder)
    known = tables.read_table(spark, root, "etl_events")
    bare = ledger.pending_files(without_content(spark, listed, folder), known).select("source_file").distinct()
    bare = bare.join(known, "source_file", "left_anti")
    if not bare.isEmpty():
        none = spark.createDataFrame([], "source_file string, value string")
        commit(spark, root, bare.persist(), none, bare.limit(0), dt.datetime.now(dt.timezone.utc))
        bare.unpersist()

    def merge_batch(lines: DataFrame, batch: int) -> None:
        files = lines.select("source_file").distinct()
        known = tables.met(tables.read_table(spark, root, "etl_events"), "etl_events", files)
        fresh = ledger.pending_files(files, known).persist()
        try:
            if not fresh.isEmpty():
                # names of files, which the listing of the stream holds anyway; else all lines are shuffled
                todo = lines.join(F.broadcast(fresh), "source_file", "left_semi")
                skipped = ledger.completed_files(files, known)
                commit(spark, root, fresh, todo, skipped, dt.datetime.now(dt.timezone.utc))
        finally:
            fresh.unpersist()

    return (
        record_stream(spark, folder, files_per_batch)
        .writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
