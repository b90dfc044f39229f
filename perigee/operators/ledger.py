"""The load ledger: one row per source file, folded from its events.

An event has `source_file`, `kind` (`start`, `complete`, `fail`), `at`, `sequence`,
`asteroids`, `approaches` and `message`. `sequence` orders events of the same instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hazard import has_status
from ..functions.ids import ledger_id

EVENTS_DDL = """source_file string, kind string, at timestamp, sequence int,
                asteroids int, approaches int, message string"""

_STATE = {"start": "running", "complete": "completed", "fail": "failed"}


def fold_events(events: DataFrame) -> DataFrame:
    """State of each file after its last event, in one aggregation.

    A new start resets the state and the message but keeps the counts and the end of an
    earlier run; an end changes the row of its file, whatever run began it.
    """
    moment = F.struct("at", "sequence")
    is_start = F.col("kind") == "start"
    done = F.when(F.col("kind") == "complete", moment)
    ended = F.when(~is_start, moment)
    last = lambda value, when: F.max_by(value, when)
    state: Column = F.lit(None).cast("string")
    for kind, name in _STATE.items():
        state = F.when(F.col("kind") == kind, F.lit(name)).otherwise(state)
    folded = events.groupBy("source_file").agg(
        F.max(F.when(is_start, F.col("at"))).alias("started_at"),
        F.max(F.when(~is_start, F.col("at"))).alias("completed_at"),
        last(state, moment).alias("status"),
        F.coalesce(last(F.col("asteroids"), done), F.lit(0)).alias("asteroids_processed"),
        F.coalesce(last(F.col("approaches"), done), F.lit(0)).alias("approaches_processed"),
        last(F.col("message"), moment).alias("message"),
    )
    message = F.when(F.col("status") == "failed", F.col("message"))
    return folded.select(
        ledger_id(F.col("source_file")).alias("id"),
        "source_file",
        "started_at",
        "completed_at",
        "status",
        F.col("asteroids_processed").cast("int").alias("asteroids_processed"),
        F.col("approaches_processed").cast("int").alias("approaches_processed"),
        message.alias("error_message"),
    )


def apply_events(ledger: DataFrame, folded: DataFrame) -> DataFrame:
    """The ledger after a run: rows of the files that the run touched are replaced, and keep
    their identifier and what the run did not set."""
    names = ledger.columns
    fresh = folded.select(
        "source_file",
        *[F.col(name).alias(f"new_{name}") for name in names if name != "source_file"],
    )
    both = ledger.join(fresh, "source_file", "full_outer")
    touched = F.col("new_status").isNotNull()
    completed = F.col("new_status") == "completed"
    new = lambda name: F.col(f"new_{name}")
    values = {
        "id": F.coalesce(F.col("id"), new("id")),
        "started_at": F.coalesce(new("started_at"), F.col("started_at")),
        "completed_at": F.coalesce(new("completed_at"), F.col("completed_at")),
        "status": F.coalesce(new("status"), F.col("status")),
        "error_message": F.when(touched, new("error_message")).otherwise(F.col("error_message")),
    }
    for name in ("asteroids_processed", "approaches_processed"):
        values[name] = F.when(completed, new(name)).otherwise(
            F.coalesce(F.col(name), new(name), F.lit(0))
        )
    return both.select(
        *[values[name].alias(name) if name in values else F.col(name) for name in names]
    )


def completed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that were loaded before."""
    done = ledger.filter(has_status(F.col("status"), "completed")).select("source_file")
    return files.join(done, "source_file", "left_semi")


def pending_files(files: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Files a load has to read: all when forced, else those not completed."""
    if force:
        return files
    done = ledger.filter(has_status(F.col("status"), "completed")).select("source_file")
    return files.join(done, "source_file", "left_anti")
