"""The read queries over asteroids, approaches and load runs.

Where every approach belongs to a stored asteroid (loads write the asteroid first, and
`orphans` checks it), pass `orphan_free=True`: a query that sorts and filters by approach
columns only is then cut down before the join, which sees a page of rows. Without it, the
join is done first, so that a page is full even if some approaches have no asteroid.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import enum

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import display
from ..functions.clock import instant
from ..functions.hazard import HAZARD_CLASSES
from ..sources.tables import in_months
from .paging import Order, check_page, columns_of, cut_page
from .shape import filter_all, one_row

# Rows of the lists as shipped, and the most rows of a page of runs.
RECENT_APPROACHES = 50
LATEST_VELOCITIES = 100
RECENT_RUNS = 20
RUNS_PAGE_LIMIT = 20
PAGE_SIZE = 20
RUNS_PAGE_SIZE = 10

# The columns of each view, and what pages can be sorted by.
APPROACH_VIEW = (
    "id",
    "asteroid_name",
    "close_approach_date",
    "velocity_km_per_h",
    "miss_distance_km",
    "hazard_classification",
    "is_potentially_hazardous",
    "estimated_diameter_avg_km",
)
VELOCITY_VIEW = ("date", "asteroid_name", "velocity_km_per_h")
RUN_VIEW = (
    "id",
    "source_file",
    "started_at",
    "completed_at",
    "status",
    "asteroids_processed",
    "approaches_processed",
    "error_message",
)

# sort key -> column; anything else sorts by date
SORT_COLUMNS = {
    "velocity": "velocity_km_per_h",
    "distance": "miss_distance_km",
    "name": "asteroid_name",
    "hazard": "hazard_classification",
}


class Period(enum.Enum):
    WEEK = "7d"
    MONTH = "30d"
    QUARTER = "90d"
    YEAR = "1y"

    def interval(self) -> Column:
        """A year is a calendar year."""
        spans = {"7d": "7 DAYS", "30d": "30 DAYS", "90d": "90 DAYS", "1y": "1 YEAR"}
        return F.expr(f"INTERVAL {spans[self.value]}")


@dataclasses.dataclass(frozen=True)
class ApproachFilter:
    """What a table page asks for; dates are inclusive, the hazard name is not checked."""

    start_date: dt.date | None = None
    end_date: dt.date | None = None
    hazard_class: str | None = None
    sort_by: str | None = None
    sort_dir: str | None = None
    page: int = 1
    page_size: int = PAGE_SIZE

    def __post_init__(self) -> None:
        check_page(self.page, self.page_size)
        if self.start_date and self.end_date and self.end_date < self.start_date:
            raise ValueError("end date is before start date")

    def conditions(self) -> list[Column]:
        date = F.col("close_approach_date")
        found = []
        if self.start_date is not None:
            found.append(date >= F.lit(self.start_date))
        if self.end_date is not None:
            found.append(date < F.lit(self.end_date + dt.timedelta(days=1)))
        if self.hazard_class is not None:
            found.append(F.col("hazard_classification") == F.lit(self.hazard_class))
        return found

    def matching(self, approaches: DataFrame) -> DataFrame:
        ends = [None if day is None else F.lit(day) for day in (self.start_date, self.end_date)]
        return filter_all(in_months(approaches, *ends), self.conditions())

    def order(self) -> Order:
        """Hazard sorts as text. The identifier makes the order total."""
        key = SORT_COLUMNS.get(self.sort_by, "close_approach_date")
        return [(key, self.sort_dir != "asc"), ("created_at", True), ("id", False)]


def _asteroid_side(asteroids: DataFrame) -> DataFrame:
    return asteroids.select(
        F.col("id").alias("asteroid_id"),
        F.col("neo_reference_id"),
        F.col("name").alias("asteroid_name"),
        "is_potentially_hazardous",
        "estimated_diameter_avg_km",
    )


def with_asteroids(approaches: DataFrame, asteroids: DataFrame) -> DataFrame:
    """Approaches with the columns of their asteroid. How to join is left to Spark: it
    broadcasts a side only when its size is known to be small, else it sort-merges and
    splits the partitions of an asteroid that holds very many rows."""
    return approaches.join(_asteroid_side(asteroids), "asteroid_id")


def _page_of(
    approaches: DataFrame,
    asteroids: DataFrame,
    order: Order,
    page: int,
    page_size: int,
    join_first: bool,
) -> DataFrame:
    if join_first:
        return cut_page(with_asteroids(approaches, asteroids), order, page, page_size)
    few = cut_page(approaches, order, page, page_size)
    return with_asteroids(few, asteroids).orderBy(*columns_of(order)).limit(page_size)


def recent_approaches(
    approaches: DataFrame, asteroids: DataFrame, orphan_free: bool = False, limit: int = RECENT_APPROACHES
) -> DataFrame:
    """The latest approaches by date."""
    newest = ApproachFilter(page_size=limit)
    return approaches_page(approaches, asteroids, newest, orphan_free)


def approaches_page(
    approaches: DataFrame, asteroids: DataFrame, wanted: ApproachFilter, orphan_free: bool = False
) -> DataFrame:
    """One page of the filtered and sorted table."""
    matching = wanted.matching(approaches)
    join_first = wanted.sort_by == "name" or not orphan_free
    page = _page_of(
        matching, asteroids, wanted.order(), wanted.page, wanted.page_size, join_first
    )
    return page.select(*APPROACH_VIEW)


def approaches_total(
    approaches: DataFrame,
    wanted: ApproachFilter,
    asteroids: DataFrame | None = None,
) -> DataFrame:
    """Rows and pages of the whole filtered result. The join adds and removes no row, so it
    is left out; pass `asteroids` for tables that may have orphans."""
    matching = wanted.matching(approaches)
    if asteroids is not None:
        keys = asteroids.select(F.col("id").alias("asteroid_id"))
        matching = matching.join(keys, "asteroid_id", "left_semi")
    total = matching.agg(F.count("*").alias("total_items"))
    return total.select(
        "total_items",
        display.total_pages(F.col("total_items"), wanted.page_size).alias("total_pages"),
        display.total_pages(F.col("total_items"), wanted.page_size, empty_pages=1).alias(
            "table_pages"
        ),
    )


def _velocity_view(approaches: DataFrame, asteroids: DataFrame) -> DataFrame:
    return with_asteroids(approaches, asteroids).withColumn("date", F.col("close_approach_date"))


def velocity_latest(
    approaches: DataFrame, asteroids: DataFrame, orphan_free: bool = False, limit: int = LATEST_VELOCITIES
) -> DataFrame:
    """The latest velocities."""
    order = [("close_approach_date", True), ("id", False)]
    page = _page_of(approaches, asteroids, order, 1, limit, not orphan_free)
    return page.withColumn("date", F.col("close_approach_date")).select(*VELOCITY_VIEW)


def first_day(period: Period, as_of: dt.datetime | None = None) -> Column:
    """The first date at or after the instant one period before `as_of`; a date is its
    midnight.

    The instant is moved up to the next midnight, so that the date column itself is
    compared and the condition can reach the scan.
    """
    begin = instant(as_of) - period.interval()
    midnight = F.to_date(begin)
    return F.when(midnight.cast("timestamp") == begin, midnight).otherwise(F.date_add(midnight, 1))


def since(period: Period, as_of: dt.datetime | None = None) -> Column:
    """Whether a date is at or after that day."""
    return F.col("close_approach_date") >= first_day(period, as_of)


def velocity_period(
    approaches: DataFrame,
    asteroids: DataFrame,
    period: Period = Period.WEEK,
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """Velocities from one period ago on, future dates included, oldest first."""
    chosen = in_months(approaches, first_day(period, as_of), None).filter(since(period, as_of))
    return _velocity_view(chosen, asteroids).orderBy("date", "id").select(*VELOCITY_VIEW)


def velocity_range(
    approaches: DataFrame,
    asteroids: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Velocities between two dates, both inclusive and optional, oldest first."""
    date = F.col("close_approach_date")
    conditions = []
    if start is not None:
        conditions.append(date >= F.lit(start))
    if end is not None:
        conditions.append(date <= F.lit(end))
    ends = [None if day is None else F.lit(day) for day in (start, end)]
    chosen = filter_all(in_months(approaches, *ends), conditions)
    return _velocity_view(chosen, asteroids).orderBy("date", "id").select(*VELOCITY_VIEW)


def velocity(
    approaches: DataFrame,
    asteroids: DataFrame,
    period: Period | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """A period goes before a date range; with neither, the last 7 days."""
    if period is None and (start is not None or end is not None):
        return velocity_range(approaches, asteroids, start, end)
    return velocity_period(approaches, asteroids, period or Period.WEEK, as_of)


def daily_avg_velocity(approaches: DataFrame) -> DataFrame:
    """Mean velocity per calendar date."""
    return (
        approaches.groupBy(F.col("close_approach_date").alias("date"))
        .agg(F.avg("velocity_km_per_h").alias("avg_velocity_km_per_h"))
        .orderBy("date")
    )


def velocity_chart(approaches: DataFrame) -> DataFrame:
    """Labelled daily means; an empty result is one placeholder row."""
    daily = daily_avg_velocity(approaches)
    points = daily.select(
        "date",
        F.date_format("date", "dd MMM yyyy").alias("label"),
        F.col("avg_velocity_km_per_h").alias("velocity"),
    )
    placeholder = daily.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit(None).cast("date").alias("date"),
        F.lit("No Data Available").alias("label"),
        F.lit(0.0).alias("velocity"),
    )
    return points.unionByName(placeholder).orderBy("date")


def count_asteroids(asteroids: DataFrame) -> DataFrame:
    return asteroids.agg(F.count("*").alias("total_asteroids"))


def count_approaches(approaches: DataFrame) -> DataFrame:
    return approaches.agg(F.count("*").alias("total_approaches"))


def count_hazardous(asteroids: DataFrame) -> DataFrame:
    return asteroids.filter("is_potentially_hazardous").agg(F.count("*").alias("hazardous_count"))


def dashboard_stats(asteroids: DataFrame, approaches: DataFrame) -> DataFrame:
    """The three counts in one row; the asteroids are read once."""
    objects = asteroids.agg(
        F.count("*").alias("total_asteroids"),
        F.count_if("is_potentially_hazardous").alias("hazardous_count"),
    )
    return one_row(objects, count_approaches(approaches)).select(
        "total_asteroids", "total_approaches", "hazardous_count"
    )


def hazard_breakdown(approaches: DataFrame) -> DataFrame:
    """Approaches per class; classes without any are there with 0."""
    counts = approaches.agg(
        *[F.count_if(F.col("hazard_classification") == name).alias(name) for name in HAZARD_CLASSES]
    )
    pairs = [
        F.struct(F.lit(name).alias("hazard_classification"), F.col(name).alias("approaches"))
        for name in HAZARD_CLASSES
    ]
    return counts.select(F.inline(F.array(*pairs)))


def count_runs(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("total_runs"))


def runs_page(
    runs: DataFrame, page: int = 1, page_size: int = RUNS_PAGE_SIZE, most: int | None = RUNS_PAGE_LIMIT
) -> DataFrame:
    """One page of load runs, newest start first. A page of more than `most` rows is refused;
    None allows any."""
    if most is not None and page_size > most:
        raise ValueError(f"a page of runs has at most {most} rows")
    order = [("started_at", True), ("id", False)]
    return cut_page(runs.select(*RUN_VIEW), order, page, page_size)


def runs_total(runs: DataFrame, page_size: int = RUNS_PAGE_SIZE) -> DataFrame:
    """Load runs, and pages of them."""
    return count_runs(runs).select(
        "total_runs", display.total_pages(F.col("total_runs"), page_size).alias("total_pages")
    )


def recent_runs(runs: DataFrame, limit: int = RECENT_RUNS) -> DataFrame:
    return runs_page(runs, 1, limit, most=None)


def last_run(runs: DataFrame) -> DataFrame:
    """End of the latest completed run in Unix seconds; NULL without one."""
    latest = runs.filter(F.col("status") == "completed").agg(F.max("completed_at").alias("at"))
    return latest.select(F.unix_timestamp("at").alias("last_etl_run"))


def asteroid_lookup(asteroids: DataFrame, wanted: DataFrame) -> DataFrame:
    """Asteroids whose `neo_reference_id` is in `wanted`. Copies of a wanted one are reduced
    first: the right side of a semi-join is not split however often a key is in it."""
    keys = wanted.select("neo_reference_id").distinct()
    return asteroids.join(keys, "neo_reference_id", "left_semi").select(*asteroids.columns)


def display_rows(page: DataFrame) -> DataFrame:
    """Table cells of a page of approaches."""
    return page.select(
        "id",
        "asteroid_name",
        display.table_date(F.col("close_approach_date")).alias("approach_date"),
        display.table_velocity(F.col("velocity_km_per_h")).alias("velocity"),
        display.table_distance(F.col("miss_distance_km")).alias("miss_distance"),
        display.diameter_text(F.col("estimated_diameter_avg_km")).alias("avg_diameter"),
        "hazard_classification",
    )
