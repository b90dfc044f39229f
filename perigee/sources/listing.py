"""What lies in a folder, asked of the file system Spark itself uses."""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def _locate(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


#: Partitions that a writing task holds open at once; those beyond are sorted first.
OPEN_FILES = 100


def write_lines(lines: DataFrame, folder: str, parts: list[str], overwrite: bool) -> None:
    """Write the column `value` as lines, a folder per partition, compressed: documents repeat
    their field names, so that gzip takes them to a tenth. Tasks keep a file open for each
    partition instead of sorting their rows by it, which would spill all text to disk once more."""
    conf, key = lines.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(OPEN_FILES))
    try:
        (
            lines.write.mode("overwrite" if overwrite else "append")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "gzip")
            .partitionBy(*parts)
            .text(folder)
        )
    finally:
        conf.set(key, before)


def exists(spark: SparkSession, folder: str) -> bool:
    files, path = _locate(spark, folder)
    return files.exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    files, path = _locate(spark, folder)
    files.delete(path, True)


def paths(spark: SparkSession, folder: str) -> list[str]:
    """Data files of a folder, empty ones included; names with `_` or `.` first are not data."""
    found = [urllib.parse.unquote(path) for path in spark.read.text(folder).inputFiles()]
    return sorted(path for path in found if path.rsplit("/", 1)[1][0] not in "_.")


_BATCH = re.compile(r"/batch_start=(\d+)-(\d+)-(\d+)/batch_end=(\d+)-(\d+)-(\d+)/[^/]+\Z")
_SOURCE = re.compile(r"/source_file=([^/]+)/[^/]+\Z")


def _name(path: str) -> tuple[str, bool]:
    """The source file that a path belongs to, and whether it is part of a landed batch."""
    found = _BATCH.search(path)
    if found:
        days = found.groups()
        return f"asteroids_{''.join(days[:3])}_{''.join(days[3:])}.json", True
    found = _SOURCE.search(path)
    return (found.group(1) if found else path.rsplit("/", 1)[1]), False


def files(spark: SparkSession, folder: str, wanted: Callable[[str], bool]) -> DataFrame:
    """Files whose source file is wanted: `source_file`, `path`, `batch`. In folders that are
    partitioned, by source file or by landed batch, that is the partition; elsewhere the
    file's own name. It is an error if a folder has data files and none of them is wanted."""
    every = paths(spark, folder)
    rows = [(name, path, batch) for path in every for name, batch in [_name(path)] if wanted(name)]
    if every and not rows:
        raise ValueError(f"{folder} has {len(every)} files, but none of the kind that is read here")
    return spark.createDataFrame(rows, "source_file string, path string, batch boolean")


def without_content(spark: SparkSession, listed: DataFrame, folder: str) -> DataFrame:
    """Those of the listed files that are empty: no reader returns a row for them. Contents
    are not read for this."""
    filled = spark.read.format("binaryFile").load(folder).select("path")
    bare = lambda path: F.regexp_replace(path, r"^[a-z0-9]+:/+", "/").alias("bare")
    return (
        listed.withColumn("bare", bare(F.col("path")))
        .join(filled.select(bare(F.col("path"))), "bare", "left_anti")
        .drop("bare")
    )
