"""Keeping the optimizer from repeating costly expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def evaluate_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often they are used later.

    The optimizer may copy a projected expression into every filter above it, and parsing a
    document once per check is what that would mean here. A generated column is not copied.
    """
    value = F.struct(*[column.alias(name) for name, column in columns.items()])
    return rows.select("*", F.inline(F.array(value)))


def evaluate_in_steps(rows: DataFrame, value: Column, *steps: Callable[[Column], Column]) -> DataFrame:
    """The same for the fields of a struct that `steps` make of `value`, one after the other.

    What a step passes on is not copied into a row, as it is between two generated columns: a
    parsed document is dearer to copy than to check.
    """
    held = F.array(value)
    for step in steps:
        held = F.transform(held, step)
    return rows.select("*", F.inline(held))
