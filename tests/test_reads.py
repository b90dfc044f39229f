import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from perigee.operators import paging, reads
from perigee.operators.reads import ApproachFilter, Period

CLASSES = ["Critical", "High", "Medium", "Low"]
DAY0 = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    objects = [(f"a{i}", f"r{i}", f"name {rng.randint(0, 9)}", i % 3 == 0, i / 10) for i in range(20)]
    events = [
        (f"p{i:04}", f"a{min(rng.randint(0, 40), 19)}", DAY0 + dt.timedelta(days=rng.randint(0, 60)),
         float(rng.randint(1, 50)), float(rng.randint(1, 50)), rng.choice(CLASSES),
         dt.datetime(2024, 3, 1) + dt.timedelta(seconds=rng.randint(0, 5)))
        for i in range(700)
    ]
    ast = spark.createDataFrame(objects, "id string, neo_reference_id string, name string, "
                                "is_potentially_hazardous boolean, estimated_diameter_avg_km double")
    ap = spark.createDataFrame(events, "id string, asteroid_id string, close_approach_date date, "
                               "velocity_km_per_h double, miss_distance_km double, "
                               "hazard_classification string, created_at timestamp")
    return ap.persist(), ast.persist(), objects, events


def expected(data, wanted):
    _, _, objects, events = data
    names = {o[0]: o for o in objects}
    rows = [e for e in events
            if (wanted.start_date is None or e[2] >= wanted.start_date)
            and (wanted.end_date is None or e[2] <= wanted.end_date)
            and (wanted.hazard_class is None or e[5] == wanted.hazard_class)]
    key = {"velocity": lambda e: e[3], "distance": lambda e: e[4], "hazard": lambda e: e[5],
           "name": lambda e: names[e[1]][2]}.get(wanted.sort_by, lambda e: e[2])
    rows.sort(key=lambda e: e[0])
    rows.sort(key=lambda e: e[6], reverse=True)
    rows.sort(key=key, reverse=wanted.sort_dir != "asc")
    begin = (wanted.page - 1) * wanted.page_size
    return [e[0] for e in rows[begin:begin + wanted.page_size]], len(rows)


WANTED = [
    ApproachFilter(),
    ApproachFilter(page=3),
    ApproachFilter(start_date=dt.date(2024, 1, 10), end_date=dt.date(2024, 1, 20), page=2),
    ApproachFilter(end_date=dt.date(2024, 1, 5), sort_dir="asc", page_size=7),
    ApproachFilter(hazard_class="High", sort_by="velocity"),
    ApproachFilter(hazard_class="high"),
    ApproachFilter(sort_by="distance", sort_dir="asc", page=2),
    ApproachFilter(sort_by="name", sort_dir="asc", page=2),
    ApproachFilter(sort_by="hazard", sort_dir="down"),
    ApproachFilter(sort_by="unknown", page=40),
]


@pytest.mark.parametrize("wanted", WANTED, ids=range(len(WANTED)))
def test_pages(data, wanted):
    ap, ast, *_ = data
    ids, total = expected(data, wanted)
    assert [r["id"] for r in reads.approaches_page(ap, ast, wanted).collect()] == ids
    again = reads.approaches_page(ap, ast, wanted, orphan_free=True)
    assert [r["id"] for r in again.collect()] == ids
    counted = reads.approaches_total(ap, wanted).first()
    assert counted["total_items"] == total
    assert counted["table_pages"] == max(1, -(-total // wanted.page_size))
    assert reads.approaches_total(ap, wanted, ast).first()["total_items"] == total


def test_orphans_are_not_shown_when_there_may_be_some(data):
    ap, ast, _, events = data
    fewer = ast.filter("id <> 'a19'")
    shown = reads.recent_approaches(ap, fewer, orphan_free=False)
    assert shown.count() == 50
    assert reads.approaches_total(ap, ApproachFilter(), fewer).first()["total_items"] == sum(
        e[1] != "a19" for e in events)


@pytest.fixture
def small_ranges(spark):
    """Ranges stay apart, however few rows they have."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("page, size", [(1, 20), (8, 19), (35, 20), (141, 5), (1, 1000), (900, 7)])
@pytest.mark.parametrize("down", [True, False])
def test_deep_pages_equal_shallow_ones(data, small_ranges, monkeypatch, page, size, down):
    ap, *_ = data
    monkeypatch.setattr(paging, "NEAR", 5)
    # nulls and many equal first keys
    rows = ap.withColumn("key", F.when(F.crc32(F.col("id").cast("binary")) % 5 > 0, F.col("hazard_classification")))
    order = [("key", down), ("velocity_km_per_h", not down), ("id", False)]
    plain = rows.orderBy(*paging.columns_of(order)).offset((page - 1) * size).limit(size)
    assert paging.cut_page(rows.repartition(5), order, page, size).collect() == plain.collect()


def test_planning_a_page_runs_nothing(spark, data):
    ap, *_ = data
    order = [("velocity_km_per_h", True), ("id", False)]
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    for page in (1, 10**9):
        context.setJobGroup(f"page {page}", "")
        found = paging.cut_page(ap, order, page, 20)
        assert not tracker.getJobIdsForGroup(f"page {page}")
        assert found.count() == (20 if page == 1 else 0)
    context.setJobGroup("", "")


def test_ranks_of_cuts_are_exact(data, small_ranges):
    ap, *_ = data
    order = [("close_approach_date", True), ("id", False)]
    held = [(r["close_approach_date"], r["id"]) for r in ap.orderBy(*paging.columns_of(order)).collect()]
    cuts = paging.rank_histogram(ap, order).collect()
    assert len(cuts) > 1
    assert all((*c["cut"],) == held[c["before"]] for c in cuts)


def test_filters_are_checked():
    for wrong in ({"page": 0}, {"page_size": 0},
                  {"start_date": dt.date(2024, 1, 2), "end_date": dt.date(2024, 1, 1)}):
        with pytest.raises(ValueError):
            ApproachFilter(**wrong)


def dates(df):
    return [r["date"] for r in df.collect()]


@pytest.mark.parametrize("hour, first", [(12, 25), (0, 24)])
def test_a_period_begins_at_its_instant(data, hour, first):
    """The day exactly a week back counts only if the clock shows midnight."""
    ap, ast, _, events = data
    at = dt.datetime(2024, 1, 31, hour)
    got = dates(reads.velocity_period(ap, ast, Period.WEEK, at))
    assert got == sorted(e[2] for e in events if e[2] >= dt.date(2024, 1, first))
    assert max(got) > at.date()


def test_a_year_is_a_calendar_year(spark):
    for at, first in ((dt.datetime(2024, 2, 29), "2023-02-28"), (dt.datetime(2025, 3, 1), "2024-03-01")):
        row = spark.sql("SELECT explode(sequence(date'2022-01-01', date'2025-12-31')) close_approach_date")
        got = row.filter(reads.since(Period.YEAR, at)).agg(F.min("close_approach_date")).first()[0]
        assert str(got) == first


def test_velocity_precedence(data):
    ap, ast, *_ = data
    at = dt.datetime(2024, 2, 20, 12)
    both = reads.velocity(ap, ast, Period.MONTH, DAY0, DAY0, at)
    assert dates(both) == dates(reads.velocity_period(ap, ast, Period.MONTH, at))
    assert set(dates(reads.velocity(ap, ast, start=DAY0, end=DAY0, as_of=at))) == {DAY0}
    assert dates(reads.velocity(ap, ast, as_of=at)) == dates(
        reads.velocity_period(ap, ast, Period.WEEK, at))


def test_velocity_latest(data):
    ap, ast, _, events = data
    newest = sorted((e[2] for e in events), reverse=True)[:100]
    assert dates(reads.velocity_latest(ap, ast)) == newest
    assert dates(reads.velocity_latest(ap, ast, orphan_free=False)) == newest


def test_daily_means(data):
    ap, _, _, events = data
    means = {}
    for e in events:
        means.setdefault(e[2], []).append(e[3])
    got = reads.daily_avg_velocity(ap).collect()
    assert [(r[0], round(r[1], 9)) for r in got] == [
        (d, round(sum(v) / len(v), 9)) for d, v in sorted(means.items())]
    chart = reads.velocity_chart(ap).collect()
    assert len(chart) == len(means) and chart[0]["label"] == chart[0]["date"].strftime("%d %b %Y")


def test_an_empty_chart_has_a_placeholder(data):
    ap, *_ = data
    assert [tuple(r) for r in reads.velocity_chart(ap.limit(0)).collect()] == [
        (None, "No Data Available", 0.0)]


def test_counts(data):
    ap, ast, objects, events = data
    assert tuple(reads.dashboard_stats(ast, ap).first()) == (20, 700, sum(o[3] for o in objects))
    assert tuple(reads.dashboard_stats(ast.limit(0), ap.limit(0)).first()) == (0, 0, 0)
    assert reads.count_hazardous(ast).first()[0] == sum(o[3] for o in objects)
    only = ap.filter("hazard_classification = 'Low'")
    assert dict(map(tuple, reads.hazard_breakdown(only).collect())) == {
        "Critical": 0, "High": 0, "Medium": 0, "Low": sum(e[5] == "Low" for e in events)}


def test_lookup(spark, data):
    _, ast, *_ = data
    wanted = spark.createDataFrame([("r3",), ("r3",), ("r9",), ("none",)], "neo_reference_id string")
    assert sorted(r["id"] for r in reads.asteroid_lookup(ast, wanted).collect()) == ["a3", "a9"]


def test_runs(spark):
    rows = [(f"i{n:02}", f"f{n}", dt.datetime(2024, 1, 1 + n % 3), dt.datetime(2024, 2, 1, n % 24),
             "completed" if n % 2 else "failed", 1, 2, None) for n in range(45)]
    runs = spark.createDataFrame(rows, "id string, source_file string, started_at timestamp, "
                                 "completed_at timestamp, status string, asteroids_processed int, "
                                 "approaches_processed int, error_message string")
    order = [r[0] for r in sorted(rows, key=lambda r: (-r[2].timestamp(), r[0]))]
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(reads.recent_runs(runs)) == order[:20]
    assert ids(reads.runs_page(runs, 2)) == order[10:20]
    assert ids(reads.runs_page(runs, 2, 20)) == order[20:40]
    assert ids(reads.runs_page(runs, 1, 500, most=None)) == order
    with pytest.raises(ValueError, match="at most 20"):
        reads.runs_page(runs, 2, 50)
    assert tuple(reads.runs_total(runs).first()) == (45, 5)
    assert reads.last_run(runs).first()[0] == int(
        dt.datetime(2024, 2, 1, 23, tzinfo=dt.timezone.utc).timestamp())
    assert reads.last_run(runs.filter("status = 'failed'")).first()[0] is None


def test_ranks_move_no_keys_and_let_filters_by_them_move(data):
    """A filter by a plan that is not deterministic stays above joins and groupings."""
    ap, *_ = data
    order = [("close_approach_date", True), ("id", False)]
    for near in (None, 1980):
        plan = paging.rank_histogram(ap, order, near)._jdf.queryExecution().optimizedPlan()
        assert plan.deterministic() and "RepartitionByExpression" not in plan.toString()
