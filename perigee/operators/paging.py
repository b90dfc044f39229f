"""Pages of a sorted result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A sort key: a column name, and whether it goes downwards. Nulls are lowest.
Order = list[tuple[str, bool]]
#: Rows that a task may keep to end with a page: a longer top list is not merged in one task.
NEAR = 1000
#: Rows of a sample that cuts are chosen from, how many of it lie between two cuts, and how many
#: cuts there are on either side. The page lies between them but for one time in hundreds.
SAMPLE, STEP, SPREAD = 1000, 8, 8


def check_page(page: int, page_size: int) -> None:
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size count from 1")


def columns_of(order: Order) -> list[Column]:
    return [F.col(name).desc() if down else F.col(name).asc() for name, down in order]


def _before(order: Order, cut: Column) -> Column:
    """Whether a row sorts before the keys in the struct `cut`."""
    found = F.lit(False)
    for name, down in reversed(order):
        column, bound = F.col(name), cut[name]
        if down:  # null is lowest: last when going down, first when going up
            strictly = (column > bound) | (column.isNotNull() & bound.isNull())
        else:
            strictly = (column < bound) | (column.isNull() & bound.isNotNull())
        found = F.coalesce(strictly, F.lit(False)) | (column.eqNullSafe(bound) & found)
    return found


def _first_key_within(order: Order, around: Column) -> Column:
    """What lying between the cuts `low` and `high` says of the first key alone. It adds nothing
    to the comparison of all keys, but can be tested where that key is read, before rows are
    joined and grouped."""
    name, down = order[0]
    column, low, high = F.col(name), around["low"], around["high"]
    at_least = lambda cut: cut.isNull() | cut[name].isNull() | (column >= cut[name])
    at_most = lambda cut: cut.isNull() | column.isNull() | (column <= cut[name])
    return at_most(low) & at_least(high) if down else at_least(low) & at_most(high)


def _cuts(rows: DataFrame, order: Order, near: int | None) -> Column:
    """Keys of some rows, in order: those about every `STEP`th of a sample around the row `near`,
    or evenly spaced ones. The sample is the `SAMPLE` rows of least hash, whose greatest hash
    tells about how many rows there are. Everything here is deterministic, so that filters by
    what comes of it can be moved."""
    names = [name for name, _ in order]
    sample = rows.select(*names, F.xxhash64(*names).alias("_hash")).orderBy("_hash").limit(SAMPLE)
    every, place = Window.partitionBy(), F.row_number().over(Window.orderBy(*columns_of(order)))
    held = sample.select(
        *names, place.alias("_place"), F.count("*").over(every).alias("_n"), F.max("_hash").over(every).alias("_last")
    )
    n, count = F.col("_n"), 2 * SPREAD + 1
    if near is None:
        index = (F.col("_place") - 1) / F.ceil(n / F.lit(count))
    else:
        share = (F.col("_last").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
        total = F.when(n < SAMPLE, n.cast("double")).otherwise((n - 1) / share)
        wanted = F.greatest(F.lit(1), F.least(n, F.round(F.lit(float(near)) / total * n))).cast("bigint")
        index = (F.col("_place") - wanted) / F.lit(STEP) + F.lit(SPREAD)
    chosen = held.select(F.struct(*names).alias("cut"), index.alias("_index"))
    return chosen.agg(
        F.array_compact(F.array(*[F.max(F.when(F.col("_index") == i, F.col("cut"))) for i in range(count)])).alias("cuts")
    ).scalar()


def rank_histogram(rows: DataFrame, order: Order, near: int | None = None) -> DataFrame:
    """A histogram of ranks: `cut`, the keys that begin a range of the order, and `before`, the
    number of rows before it. Cuts are keys of a sample; then the rows of each range are counted
    where they are, so the numbers are exact and no key is moved. Given `near`, the cuts lie
    closely around the row of about that rank."""
    keys, cuts = rows.select(*[name for name, _ in order]), _cuts(rows, order, near)

    def range_of(held: Column) -> Column:
        # most rows lie before the first cut or after the last
        behind = F.size(F.filter(held, lambda cut: ~_before(order, cut)))
        return F.when(_before(order, F.get(held, F.lit(0))), F.lit(0)).when(
            ~_before(order, F.get(held, F.size(held) - 1)), F.size(held)
        ).otherwise(behind)

    # a lambda takes no subquery itself
    ranges = keys.withColumn("_cuts", cuts).select(F.get(F.transform(F.array("_cuts"), range_of), F.lit(0)).alias("part"))
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = [F.coalesce(F.sum(F.when(F.col("part") <= i, F.col("n"))), F.lit(0)) for i in range(2 * SPREAD + 1)]
    found = sizes.agg(F.array(*before).alias("ranks")).select("ranks", F.posexplode(cuts).alias("part", "cut"))
    return found.select("part", "cut", F.get("ranks", F.col("part")).alias("before"))


def cut_page(rows: DataFrame, order: Order, page: int, page_size: int) -> DataFrame:
    """Rows of a 1-based page. `order` must be total.

    Nothing runs before the result is asked for, at any depth. The first rows are a top list,
    of which every task keeps its own. Of what lies deeper, a histogram of ranks tells between
    which cuts the page is; another scan takes the rows between them, about as many as a task
    of a sort has, and their ranks go on from the number of rows before. Should the page lie
    outside of the cuts the rows are more, and the page is the same. No task and no driver
    holds the skipped rows else. The rows must be the same each time they are read.
    """
    check_page(page, page_size)
    skipped = (page - 1) * page_size
    end = skipped + page_size
    if end <= NEAR:
        return rows.orderBy(*columns_of(order)).offset(skipped).limit(page_size)
    part, before = F.col("part"), F.col("before")
    around = rank_histogram(rows, order, skipped).agg(F.struct(
        F.max_by("cut", F.when(before <= skipped, part)).alias("low"),
        F.min_by("cut", F.when(before >= end, part)).alias("high"),
        F.coalesce(F.max(F.when(before <= skipped, before)), F.lit(0)).alias("before"),
    ).alias("around")).scalar()
    between = lambda held: (held["low"].isNull() | ~_before(order, held["low"])) & (
        held["high"].isNull() | _before(order, held["high"])
    )
    near = rows.filter(_first_key_within(order, around)).withColumn("_around", around)
    near = near.filter(F.exists(F.array("_around"), between)).drop("_around")
    rank = F.row_number().over(Window.orderBy(*columns_of(order))) + around["before"]
    found = near.select("*", rank.alias("page_rank")).filter(F.col("page_rank").between(skipped + 1, end))
    return found.orderBy("page_rank").drop("page_rank")
