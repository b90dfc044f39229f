import datetime as dt
import json

import pytest
from feeds import approach, documents, feed, neo
from pyspark.sql import functions as F

from perigee.plans import transform
from perigee.sources import batches
from perigee.sources import feed as source

EMPTY = {"links": {"next": None, "previous": None, "self": "x"}, "element_count": 0,
         "near_earth_objects": {"2024-01-01": []}}
ERROR = {"error": {"code": "INVALID_KEY", "message": "not valid"}}


def flat(docs, strict=True):
    objects = source.feed_objects(source.valid_feeds(source.decode_feed(docs), strict))
    return source.asteroid_rows(objects, F.current_timestamp()), source.approach_rows(objects, F.current_timestamp())


def test_one_object(spark):
    asteroids, approaches = flat(documents(spark, feed()))
    one, event = asteroids.collect(), approaches.collect()
    assert len(one) == len(event) == 1
    assert one[0]["estimated_diameter_avg_km"] == 1.5
    assert event[0]["hazard_classification"] == "Critical"
    assert event[0]["asteroid_id"] == one[0]["id"]
    assert event[0]["close_approach_date"] == dt.date(2024, 1, 1)


def test_empty_feed_is_no_error(spark):
    asteroids, approaches = flat(documents(spark, EMPTY))
    assert asteroids.count() == approaches.count() == 0


def test_object_without_approach_keeps_its_row(spark):
    docs = documents(spark, feed({"2024-01-01": [neo("A", approaches=[]), neo("B")]}))
    asteroids, approaches = flat(docs)
    assert asteroids.count() == 2
    assert approaches.count() == 1


def test_numbers_and_text_mix(spark):
    items = [approach(speed=25.5), approach(speed="25.5", epoch=2)]
    _, approaches = flat(documents(spark, feed({"2024-01-01": [neo(approaches=items)]})))
    assert [r["velocity_km_per_s"] for r in approaches.collect()] == [25.5, 25.5]


def test_nan_velocity_is_read_and_raises_no_class(spark):
    quiet = neo("A", pha=False, low=0.01, high=0.05, approaches=[approach(speed="NaN")])
    _, approaches = flat(documents(spark, feed({"2024-01-01": [quiet]})))
    assert approaches.first()["hazard_classification"] == "Low"


def without(item, *path):
    copy = json.loads(json.dumps(item))
    place = copy
    for step in path[:-1]:
        place = place[step]
    del place[path[-1]]
    return copy


BAD = {
    "error document": ERROR,
    "no json": "{ broken",
    "array": "[1, 2]",
    "no links": without(feed(), "links"),
    "negative count": feed(element_count=-1),
    "text count": feed(element_count="1"),
    "no date": feed({"d": [neo(approaches=[without(approach(), "close_approach_date")])]}),
    "odd date": feed({"d": [neo(approaches=[approach(date="2024-13-01")])]}),
    "text epoch": feed({"d": [neo(approaches=[approach(epoch="1704067200000")])]}),
    "padded number": feed({"d": [neo(approaches=[approach(speed=" 1.5 ")])]}),
    "suffixed number": feed({"d": [neo(approaches=[approach(speed="1.5d")])]}),
    "no number": feed({"d": [neo(approaches=[approach(au="abc")])]}),
    "list for number": feed({"d": [neo(approaches=[approach(au=[1, 2])])]}),
    "null approach": feed({"d": [neo(approaches=[None])]}),
    "no approach list": feed({"d": [without(neo(), "close_approach_data")]}),
    "no feet": feed({"d": [without(neo(), "estimated_diameter", "feet")]}),
    "text magnitude": feed({"d": [neo(absolute_magnitude_h="20.0")]}),
    "NaN magnitude": feed({"d": [neo(absolute_magnitude_h="NaN")]}),
    "text flag": feed({"d": [neo(is_potentially_hazardous_asteroid="true")]}),
    "second object bad": feed({"d": [neo("A"), without(neo("B"), "name")]}),
    "second day bad": feed({"d": [neo("A")], "e": [without(neo("B"), "links")]}),
}


@pytest.mark.parametrize("name", list(BAD))
def test_bad_documents_are_refused(spark, name):
    docs = documents(spark, feed(), BAD[name])
    decoded = source.decode_feed(docs).orderBy("source_file").collect()
    assert decoded[0]["decode_error"] is None
    assert decoded[1]["decode_error"] is not None


def test_strict_names_the_file_and_lenient_goes_on(spark):
    docs = documents(spark, feed(), ERROR)
    with pytest.raises(Exception, match="cannot read f1.json"):
        flat(docs)[0].collect()
    assert flat(docs, strict=False)[0].count() == 1


def test_unknown_keys_and_missing_optional_ones_are_fine(spark):
    item = feed(extra={"a": 1})
    item["links"] = {"self": "x"}
    assert source.decode_feed(documents(spark, item)).first()["decode_error"] is None


def test_date_range_selects_by_listing_day(spark):
    days = {f"2024-01-0{d}": [neo(f"N{d}")] for d in range(1, 6)}
    feeds = source.valid_feeds(source.decode_feed(documents(spark, feed(days))))
    got = source.feed_objects(feeds, dt.date(2024, 1, 2), dt.date(2024, 1, 4))
    assert {r[0] for r in got.select("neo.neo_reference_id").collect()} == {"N2", "N3", "N4"}


def test_declared_count_is_checked(spark):
    docs = documents(spark, feed(), feed(element_count=7), EMPTY)
    rows = source.object_counts(source.decode_feed(docs)).orderBy("source_file").collect()
    assert [(r["actual_count"], r["consistent"]) for r in rows] == [(1, True), (1, False), (0, True)]


def test_scan_takes_only_plain_json_files(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(feed(), indent=2))
    (tmp_path / "a.json").write_text(json.dumps(feed()))
    (tmp_path / "_metadata.json").write_text("{}")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "c.json").write_text(json.dumps(feed()))
    docs = source.scan_feed_files(spark, str(tmp_path))
    assert sorted(r["source_file"] for r in docs.collect()) == ["a.json", "b.json"]
    assert flat(docs)[0].count() == 2


def test_landing_and_pruned_reading(spark, tmp_path):
    planned = batches.plan_batches(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 20), 7)
    docs = planned.select(
        F.col("batch_file").alias("source_file"),
        F.lit(json.dumps(feed(), indent=1)).alias("document"), "batch_start", "batch_end")
    folder = str(tmp_path / "raw")
    source.land(docs, folder)
    read = source.read_landed(spark, folder, dt.date(2024, 1, 8), dt.date(2024, 1, 14))
    assert [r["source_file"] for r in read.collect()] == ["asteroids_20240108_20240114.json"]
    assert flat(read)[0].count() == 1
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(batch_end" in plan


def test_records_agree_with_flat_rows(spark):
    days = {"2024-01-01": [neo("A", approaches=[approach(), approach(epoch=5, speed=30)])],
            "2024-01-02": [neo("B", approaches=[]), neo("C", pha=False)]}
    docs = documents(spark, feed(days))
    nested = transform.transform_feed(docs, dt.datetime(2024, 5, 1))
    asteroids, approaches = flat(docs)
    keys = lambda df: sorted(map(tuple, df.collect()))
    assert keys(nested.select("asteroid.id")) == keys(asteroids.select("id"))
    names = ["id", "asteroid_id", "hazard_classification", "velocity_km_per_s", "miss_distance_km"]
    assert keys(nested.select(F.inline("approaches")).select(*names)) == keys(approaches.select(*names))


def test_batches(spark):
    plan = batches.plan_batches(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 16), 7)
    rows = [tuple(r) for r in plan.select("batch_number", "batch_start", "batch_end", "batch_file")
            .orderBy("batch_number").collect()]
    assert rows == [
        (1, dt.date(2024, 1, 1), dt.date(2024, 1, 7), "asteroids_20240101_20240107.json"),
        (2, dt.date(2024, 1, 8), dt.date(2024, 1, 14), "asteroids_20240108_20240114.json"),
        (3, dt.date(2024, 1, 15), dt.date(2024, 1, 16), "asteroids_20240115_20240116.json"),
    ]
    for days in range(1, 30):
        start, end = dt.date(2024, 1, 2), dt.date(2024, 1, 1) + dt.timedelta(days=days)
        assert batches.plan_batches(spark, start, max(start, end), 4).count() == batches.batch_count(
            start, max(start, end), 4)


def test_range_validation(spark):
    with pytest.raises(ValueError):
        batches.validate_range(dt.date(2024, 1, 2), dt.date(2024, 1, 1))
    with pytest.warns(UserWarning):
        batches.validate_range(dt.date(2020, 1, 1), dt.date(2024, 1, 1))
    with pytest.warns(UserWarning):
        batches.validate_range(dt.date(2020, 1, 1), dt.date(2020, 1, 1))
    with pytest.raises(ValueError):
        batches.plan_batches(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 9), 0)
