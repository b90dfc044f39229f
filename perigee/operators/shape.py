"""Small helpers shared by the operators."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F


def keep_first(rows: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by `order`.

    The remaining columns break ties, so the outcome never depends on task order. It is an
    aggregate, not a window: copies are reduced before the shuffle, and a key that holds
    most of the rows never has to fit into one task.
    """
    rest = [name for name in rows.columns if name not in keys and name not in order]
    pick = F.max if last else F.min
    winner = pick(F.struct(*order, *rest)).alias("winner")
    picked = rows.groupBy(*keys).agg(winner)
    return picked.select(
        *[F.col(name) if name in keys else F.col("winner")[name].alias(name) for name in rows.columns]
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """Side by side: the columns of several one-row frames in a single row."""
    together = functools.reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True), frames
    )
    return together.agg(*[F.max(name).alias(name) for name in together.columns])


def all_of(conditions: list[Column]) -> Column:
    return functools.reduce(lambda left, right: left & right, conditions, F.lit(True))


def filter_all(rows: DataFrame, conditions: list[Column]) -> DataFrame:
    return rows.filter(all_of(conditions)) if conditions else rows
