"""Instants given by the caller, or the clock of the query."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def instant(at: dt.datetime | None) -> Column:
    """`at` as a timestamp. Without a zone it is UTC, wherever the driver runs."""
    if at is None:
        return F.current_timestamp()
    if at.tzinfo is None:
        at = at.replace(tzinfo=dt.timezone.utc)
    return F.lit(at.isoformat()).cast("timestamp")


def day(at: dt.date | None) -> Column:
    return F.current_date() if at is None else F.lit(at)
