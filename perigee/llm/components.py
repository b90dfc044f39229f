"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder that the session names. Only a local session
    that names none, as in tests, gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark) -> str:
    """The folder of `spark.checkpoint.dir`."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="perigee-llm-")


def remove(spark, folder: str) -> None:
    """Deletes a folder that an earlier step wrote, in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("low"))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(CAST(b AS DECIMAL(38, 0)))")).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the least node it reaches.

    Each round links all larger neighbours of a node to the least node of its neighbourhood
    (large star), then all smaller ones (small star), until the links are stars around the
    least nodes. Rounds go with the logarithm of the longest path. A hub with very many links
    is a skewed key of a join whose other side has one row per key, which adaptive execution
    splits. Links of a node to itself and repeated links change nothing.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = checkpoint(links)
    before = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both).withColumn("low", F.least("a", "low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = _lowest(large)
        small = (
            large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                                                          F.struct("a", F.col("low").alias("b")))).alias("x"))
            .select("x.a", "x.b").where("a <> b").distinct()
        )
        links = checkpoint(small)
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
