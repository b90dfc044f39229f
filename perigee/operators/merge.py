"""Upserts as DataFrame merges, and the keys between the tables.

Each side of a merge is read and deduplicated once. `existing` is best restricted before to
what the incoming rows can meet, as `plans.load` does by partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import packed_uuid, unpacked_uuid
from ..sources.feed import average_diameter
from .shape import keep_first

ASTEROID_KEY = ["neo_reference_id"]
APPROACH_KEY = ["asteroid_id", "epoch_date_close_approach"]
ALERT_KEY = ["approach_id", "alert_type"]
# an update never touches these
KEPT = ("id", "created_at")


def _without_known(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in `existing`; `rows` has one row per key and is made once. Of
    `existing` only the keys are moved."""
    return rows.join(existing.select(*keys), keys, "left_anti")


def latest_asteroids(incoming: DataFrame, order: list[str]) -> DataFrame:
    """One row per object; the one listed last wins."""
    return keep_first(incoming, ASTEROID_KEY, order, last=True)


def first_approaches(incoming: DataFrame, order: list[str]) -> DataFrame:
    """One row per object and instant; the one seen first wins."""
    return keep_first(incoming, APPROACH_KEY, order)


def upsert_asteroids(existing: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """The whole table after the merge: known objects get the new values but keep their
    identifier and creation time, unknown ones are added."""
    columns = existing.columns
    latest = latest_asteroids(incoming, order)
    return _with_average(_merged(existing, latest).select(*columns))


def _merged(existing: DataFrame, latest: DataFrame) -> DataFrame:
    columns = existing.columns
    fresh = latest.select(
        *ASTEROID_KEY,
        *[F.col(name).alias(f"new_{name}") for name in columns if name not in ASTEROID_KEY],
        F.lit(True).alias("changed"),
    )
    old = existing.withColumn("stored", F.lit(True))
    return old.join(fresh, ASTEROID_KEY, "full_outer").select(
        *[
            F.col(name)
            if name in ASTEROID_KEY
            else F.when(F.col("stored") if name in KEPT else F.col("changed").isNull(), F.col(name))
            .otherwise(F.col(f"new_{name}"))
            .alias(name)
            for name in columns
        ]
    )


def _with_average(asteroids: DataFrame) -> DataFrame:
    if "estimated_diameter_avg_km" not in asteroids.columns:
        return asteroids
    return asteroids.drop("estimated_diameter_avg_km").select("*", average_diameter()).select(
        *asteroids.columns
    )


def new_approaches(existing: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Rows to append: first per key, and not in the table yet.

    Of all that is moved here the identifier is most, as its digits do not compress: it is
    packed on the way.
    """
    packed = lambda rows: rows.withColumn("asteroid_id", packed_uuid(F.col("asteroid_id")))
    first = first_approaches(packed(incoming), order)
    added = _without_known(first, packed(existing.select(*APPROACH_KEY)), APPROACH_KEY)
    return added.withColumn("asteroid_id", unpacked_uuid(F.col("asteroid_id"))).select(*incoming.columns)


def upsert_approaches(
    existing: DataFrame,
    incoming: DataFrame,
    order: list[str],
    complete: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The whole table after the merge: a stored row always wins over an incoming one.

    All incoming rows are moved to choose those to add. With `complete`, which makes whole rows
    of the chosen ones, they need no columns but the key, `order` and what the others come from.
    """
    added = new_approaches(existing, incoming, order)
    if complete is not None:
        added = complete(added)
    return existing.unionByName(added.select(*existing.columns))


def insert_ignoring(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append under a unique key. `incoming` has one row per key."""
    return _without_known(incoming, existing, keys)


def upsert_stats(
    existing_asteroids: DataFrame,
    incoming_asteroids: DataFrame,
    existing_approaches: DataFrame,
    incoming_approaches: DataFrame,
) -> DataFrame:
    """One row: what a merge inserts, updates and skips. Keys only are shuffled."""
    objects = incoming_asteroids.select(
        F.col("neo_reference_id").alias("reference"),
        F.lit(None).cast("string").alias("asteroid_id"),
        F.lit(None).cast("bigint").alias("epoch"),
    )
    events = incoming_approaches.select(
        F.lit(None).cast("string").alias("reference"),
        "asteroid_id",
        F.col("epoch_date_close_approach").alias("epoch"),
    )
    return merge_counts(objects.unionByName(events), existing_asteroids, existing_approaches)


def merge_counts(keys: DataFrame, existing_asteroids: DataFrame, existing_approaches: DataFrame) -> DataFrame:
    """The same from the keys of what comes in (`reference`, `asteroid_id`, `epoch`; NULL epoch
    for an object), read once: stored and incoming keys are grouped together."""
    is_object = F.col("epoch").isNull()
    incoming = keys.select(
        F.when(is_object, F.col("reference")).otherwise(F.col("asteroid_id")).alias("key"),
        "epoch", F.lit(1).alias("rows"), F.lit(False).alias("stored"),
    )
    stored = existing_asteroids.select(F.col("neo_reference_id").alias("key"), F.lit(None).cast("bigint").alias("epoch")).unionByName(
        existing_approaches.select(F.col("asteroid_id").alias("key"), F.col("epoch_date_close_approach").alias("epoch"))
    ).select("key", "epoch", F.lit(0).alias("rows"), F.lit(True).alias("stored"))
    grouped = incoming.unionByName(stored).groupBy("key", "epoch").agg(
        F.sum("rows").alias("rows"), F.max("stored").alias("stored")
    ).filter("rows > 0")
    fresh = ~F.col("stored")
    return grouped.agg(
        F.count_if(is_object & fresh).alias("asteroids_inserted"),
        F.count_if(is_object & ~fresh).alias("asteroids_updated"),
        F.count_if(~is_object & fresh).alias("approaches_inserted"),
        (F.coalesce(F.sum(F.when(~is_object, F.col("rows"))), F.lit(0)) - F.count_if(~is_object & fresh)).alias("approaches_skipped"),
    )


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows that point at a parent which is not there."""
    keys = parents.select(F.col(parent_key).alias(child_key))
    return children.join(keys, child_key, "left_anti").select(*children.columns)


def cascade_delete(
    removed: DataFrame, asteroids: DataFrame, approaches: DataFrame, alerts: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the asteroids in `removed` (column `id`) and without what
    hangs on them. What goes is found first, so each join tests against the smaller side."""
    gone = removed.select("id").distinct()
    gone_approaches = approaches.join(
        gone.select(F.col("id").alias("asteroid_id")), "asteroid_id", "left_semi"
    ).select(F.col("id").alias("approach_id"))
    kept_asteroids = asteroids.join(gone, "id", "left_anti")
    kept_approaches = approaches.join(
        gone.select(F.col("id").alias("asteroid_id")), "asteroid_id", "left_anti"
    )
    kept_alerts = alerts.join(gone_approaches, "approach_id", "left_anti")
    return (
        kept_asteroids.select(*asteroids.columns),
        kept_approaches.select(*approaches.columns),
        kept_alerts.select(*alerts.columns),
    )
