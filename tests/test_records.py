import datetime as dt
import json

from feeds import approach, documents, feed, neo
from pyspark.sql import functions as F

from perigee.plans.transform import transform_feed
from perigee.sources import records

AT = dt.datetime(2024, 5, 1, 12, 30, 15, 123456)


def lines_of(spark, days):
    return records.encode_records(transform_feed(documents(spark, feed(days)), AT))


def decode(spark, *lines):
    rows = spark.createDataFrame([("f_transformed.json", line) for line in lines],
                                 "source_file string, value string")
    return records.decode_records(rows)


def test_a_line_is_a_pair(spark):
    line = lines_of(spark, {"2024-01-01": [neo()]}).first()
    assert line["source_file"] == "f0_transformed.json"
    asteroid, approaches = json.loads(line["value"])
    assert asteroid["neo_reference_id"] == "REF123"
    assert asteroid["created_at"] == "2024-05-01T12:30:15.123456Z"
    assert approaches[0]["close_approach_date"] == "2024-01-01"
    assert approaches[0]["hazard_classification"] == "Critical"
    assert set(asteroid) == set(records.schemas.ASTEROID_RECORD.names)
    assert set(approaches[0]) == set(records.schemas.APPROACH_RECORD.names)


def test_round_trip(spark):
    days = {"2024-01-01": [neo("A", approaches=[approach(), approach(epoch=9)]),
                           neo("B", approaches=[])]}
    nested = transform_feed(documents(spark, feed(days)), AT)
    decoded = records.decode_records(records.encode_records(nested))
    assert {r["state"] for r in decoded.collect()} == {"valid"}
    before = nested.select("asteroid.*").orderBy("id").collect()
    after = records.record_asteroids(decoded).drop("source_file", "estimated_diameter_avg_km")
    assert after.orderBy("id").collect() == before
    events = nested.select(F.inline("approaches")).orderBy("id").collect()
    again = records.record_approaches(decoded).drop("source_file").orderBy("id").collect()
    assert again == events


def test_what_is_not_a_number_is_malformed_at_load(spark):
    days = {"2024-01-01": [neo("A", approaches=[approach(speed="NaN")]), neo("B")]}
    decoded = records.decode_records(lines_of(spark, days))
    assert sorted(r["state"] for r in decoded.collect()) == ["malformed", "valid"]


def test_states(spark):
    good = lines_of(spark, {"2024-01-01": [neo()]}).first()["value"]
    asteroid, approaches = json.loads(good)
    pair = lambda a, p: json.dumps([a, p])
    bad = [
        good[:-5],
        "{}",
        "[]",
        json.dumps([asteroid]),
        json.dumps([asteroid, approaches, 1]),
        pair({**asteroid, "id": "no-uuid"}, approaches),
        pair({**asteroid, "absolute_magnitude": "20"}, approaches),
        pair({**asteroid, "created_at": "yesterday"}, approaches),
        pair({k: v for k, v in asteroid.items() if k != "name"}, approaches),
        pair(asteroid, [{**approaches[0], "hazard_classification": "Hazardous"}]),
        pair(asteroid, [{**approaches[0], "epoch_date_close_approach": "1"}]),
        pair(asteroid, [{**approaches[0], "close_approach_date": "01/02/2024"}]),
        pair(asteroid, [approaches[0], None]),
        pair(asteroid, None),
        "plain text",
    ]
    fine = [good, f"  \t{good}  ", pair(asteroid, []), pair({**asteroid, "more": 1}, approaches)]
    blank = ["", "   ", "\t"]
    for lines, state in ((fine, "valid"), (bad, "malformed"), (blank, "blank")):
        for line in lines:
            assert decode(spark, line).first()["state"] == state, line


def test_audit(spark):
    good = lines_of(spark, {"2024-01-01": [neo()]}).first()["value"]
    rows = [("a", good), ("a", "bad"), ("a", " "), ("a", good), ("b", "bad"), ("b", ""), ("c", " ")]
    lines = spark.createDataFrame(rows, "source_file string, value string")
    audit = records.record_audit(records.decode_records(lines)).orderBy("source_file").collect()
    assert [tuple(r) for r in audit] == [
        ("a", 2, 1, 1, True), ("b", 0, 1, 1, False), ("c", 0, 0, 1, False)]


def test_partitioned_and_flat_scans(spark, tmp_path):
    nested = transform_feed(documents(spark, feed(), feed()), AT)
    folder = str(tmp_path / "out")
    records.write_records(nested, folder)
    read = records.scan_record_partitions(spark, folder)
    assert sorted(r["source_file"] for r in read.collect()) == [
        "f0_transformed.json", "f1_transformed.json"]
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "x_transformed.json").write_text("a\nb\n")
    (flat / "x.json").write_text("c\n")
    assert [r[0] for r in records.record_files(spark, str(flat)).collect()] == ["x_transformed.json"]
