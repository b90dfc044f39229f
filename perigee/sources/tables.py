"""Stored tables as plain partitioned Parquet, one folder per table.

Asteroids and the ledger change by key: they are cut into buckets of it, and a load reads and
rewrites the buckets that it has keys for. Approaches and alerts only grow and are appended
to. A table is always one scan, and what a load costs does not depend on the loads before it.

The ledger is written last. A load that ends before is repeated: its files are not completed,
its asteroids are merged to the same values, and its approaches are found to be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .. import schemas
from .listing import exists, remove

#: Partitions of the approaches, and of the other tables; what those are cut by.
MONTH, EPOCHS, BUCKET = "date_month", "epoch_bucket", "key_bucket"
KEYS = {"asteroids": "neo_reference_id", "etl_events": "source_file", "alerts": "approach_id"}
#: Buckets of a table; fixed once it has rows.
BUCKETS = 64
# About a month in milliseconds.
BUCKET_MS = 2_629_800_000


def date_month(date: Column) -> Column:
    """Months since year 0: what reads filter by."""
    return F.year(date) * 12 + F.month(date)


def partitions(table: str) -> dict[str, Column]:
    """The partition columns of a table, made of its own. That of the epoch goes by the unique
    key alone, so a duplicate can only lie in the same one; a whole division, so no instant is
    out of range."""
    if table in KEYS:
        return {BUCKET: F.pmod(F.xxhash64(KEYS[table]), F.lit(BUCKETS)).cast("int")}
    epoch = F.call_function("div", F.col("epoch_date_close_approach"), F.lit(BUCKET_MS).cast("bigint"))
    return {MONTH: date_month(F.col("close_approach_date")), EPOCHS: epoch}


def in_months(rows: DataFrame, first: Column | None, last: Column | None) -> DataFrame:
    """The partitions that dates from `first` to `last` can lie in, where rows have them."""
    if MONTH not in rows.columns:
        return rows
    if first is not None:
        rows = rows.filter(F.col(MONTH) >= date_month(first))
    return rows if last is None else rows.filter(F.col(MONTH) <= date_month(last))


def met(stored: DataFrame, table: str, incoming: DataFrame) -> DataFrame:
    """The stored rows, without partition columns, that can share a key with incoming ones. Their partitions are a filter
    of the scan, found while the query runs."""
    name = BUCKET if table in KEYS else EPOCHS
    if name not in stored.columns:
        return stored
    touched = incoming.select(partitions(table)[name].alias(name)).distinct()
    return stored.join(touched, name, "left_semi").select(*schemas.TABLES[table].names)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table with its partition columns; empty where nothing has been written."""
    types = {MONTH: T.IntegerType(), EPOCHS: T.LongType(), BUCKET: T.IntegerType()}
    schema = T.StructType([*schemas.TABLES[table].fields, *[T.StructField(c, types[c]) for c in partitions(table)]])
    place = f"{root}/{table}"
    return spark.read.schema(schema).parquet(place) if exists(spark, place) else spark.createDataFrame([], schema)


def _write(rows: DataFrame, root: str, table: str, mode: str) -> None:
    parts = partitions(table)
    rows = rows.select(*schemas.TABLES[table].names, *[made.alias(name) for name, made in parts.items()])
    # few files per partition, and one with most of the rows is split over tasks
    writer = rows.hint("rebalance", *parts).write.mode(mode).partitionBy(*parts)
    writer.option("partitionOverwriteMode", "dynamic").parquet(f"{root}/{table}")


def append(rows: DataFrame, root: str, table: str) -> None:
    """Add rows whose keys are not in the table yet."""
    _write(rows, root, table, "append")


def rewrite(rows: DataFrame, root: str, table: str) -> None:
    """Put the rows in place of the partitions that they lie in. They may come from there: what
    is written takes its place when all of it has been."""
    _write(rows, root, table, "overwrite")


def delete(spark: SparkSession, root: str, table: str, key: str, gone: DataFrame) -> None:
    """Remove the rows whose `key` is in `gone`, rewriting the partitions that have any. Only
    names of partitions reach the driver."""
    parts = list(partitions(table))
    held = read_table(spark, root, table)
    touched = held.join(gone, key, "left_semi").select(*parts).distinct()
    rest = held.join(touched, parts, "left_semi").join(gone, key, "left_anti")
    emptied = set(touched.collect()) - set(rest.select(*parts).distinct().collect())
    rewrite(rest, root, table)
    for row in emptied:
        remove(spark, "/".join([root, table, *[f"{name}={row[name]}" for name in parts]]))


def ensure_tables(spark: SparkSession, root: str) -> None:
    """Create the tables that are not there, without rows."""
    for name, schema in schemas.TABLES.items():
        if not exists(spark, f"{root}/{name}"):
            append(spark.createDataFrame([], schema), root, name)
