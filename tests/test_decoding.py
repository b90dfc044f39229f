import datetime as dt

import pytest
from feeds import approach, documents, feed, neo
from pyspark.sql import functions as F

from perigee.sources import feed as source
from workload import mapping


def test_plain_documents_are_checked_without_lambdas(spark, monkeypatch):
    monkeypatch.setattr(source, "_object_ok", lambda neo: F.raise_error(F.lit("by a lambda")).cast("boolean"))
    plain = [feed(), feed({"2024-01-01": [neo("A", approaches=[approach(), approach(speed=7, au="1e-3")])], "e": [neo("B")]})]
    assert [r["decode_error"] for r in source.decode_feed(documents(spark, *plain)).collect()] == [None] * 2
    for other in (approach(speed="inf"), approach(date="2024-13-01"), approach(au="1,2"), None):
        with pytest.raises(Exception, match="by a lambda"):
            source.decode_feed(documents(spark, feed({"d": [neo(approaches=[other])]}))).collect()


ODD = {  # speeds and dates that only the checks of one value know, and what becomes of them
    "inf": ({"speed": "+Infinity"}, float("inf")),
    "-inf": ({"speed": "-INF"}, float("-inf")),
    "too large": ({"speed": "1e999"}, float("inf")),
    "first day": ({"date": "0001-01-01"}, 15.0),
    "short date": ({"date": "2024-1-2"}, 15.0),
    "point": ({"speed": "1."}, 1.0),
    "sentinel": ({"orbiting_body": "\0 absent \0"}, 15.0),
    "least epoch": ({"epoch": -9223372036854775807}, 15.0),
    "least number": ({"speed": "-4.9e-324"}, -4.9e-324),
}
WRONG = {
    "two dates": {"date": "2024-01-01,2024-01-02"}, "date and comma": {"date": "2024-01-01,"}, "year": {"date": "2024"},
    "time": {"date": "2024-01-01 00:00"}, "two numbers": {"speed": "1,2"}, "signs": {"speed": "1-2"}, "points": {"speed": "."},
    "hexadecimal": {"speed": "0x1p3"}, "no text": {"speed": ""}, "blank": {"speed": " "}, "no body": {"orbiting_body": None},
    "no numbers": {"miss_distance": None}, "one number less": {"miss_distance": {"astronomical": "1", "lunar": "1", "miles": "1"}},
}


@pytest.mark.parametrize("name", [*ODD, *WRONG])
def test_odd_values_among_plain_ones(spark, name):
    other = (ODD[name][0] if name in ODD else WRONG[name]) | {"epoch": ODD.get(name, ({},))[0].get("epoch", 5)}
    day = {"2024-01-01": [neo("A"), neo("B", approaches=[approach(), approach(**other)])]}
    decoded = source.decode_feed(documents(spark, feed(day), feed()))
    errors = [r["decode_error"] is None for r in decoded.orderBy("source_file").collect()]
    assert errors == [name in ODD, True]
    rows = source.approach_rows(source.feed_objects(source.valid_feeds(decoded, strict=False)), F.current_timestamp())
    got = sorted(r["velocity_km_per_s"] for r in rows.filter("source_file = 'f0.json'").collect())
    assert got == (sorted([15.0, 15.0, ODD[name][1]]) if name in ODD else [])


def test_sizes_that_are_no_numbers_are_refused(spark):
    text = documents(spark, feed({"d": [neo("A"), neo("B", low=7.125)]})).first()["document"]
    docs = spark.createDataFrame([(n, text.replace("7.125", n)) for n in ("1", "1e999", "-1e999", "null")], "source_file string, document string")
    got = {r["source_file"]: r["decode_error"] is None for r in source.decode_feed(docs).collect()}
    assert got == {"1": True, "1e999": False, "-1e999": False, "null": False}


def _tables(spark, folder):
    day = lambda y, m, d: dt.datetime(y, m, d)
    lines = [(n, 1 + n % 2, 1 + n % 3, n, 4.5 * n, 0.03, 0.01, day(*date)) for n, date in enumerate(
        [(1998, 1, 2), (1995, 12, 31), (1000, 1, 1), (999, 2, 28), (9999, 12, 24), (9999, 12, 30), (2024, 2, 29), (1, 1, 8)])]
    lines += [(9, 1, 1, None, 1.0, 0.5, 0.5, day(1998, 1, 2)), (10, 1, 2, 1, None, 0.5, 0.5, day(1998, 1, 2)), (11, 1, 1, 1, 1.0, float("nan"), 0.5, day(1998, 1, 2))]
    spark.createDataFrame(
        lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp_ntz"
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(
        [(1, 'odd "name"\\', 8, 1000.0), (2, "é", 3, float("inf")), (3, None, 3, 2.0)],
        "p_partkey bigint, p_name string, p_size int, p_retailprice double",
    ).write.parquet(f"{folder}/part.parquet")


@pytest.mark.parametrize("lean", [False, True])
def test_documents_joined_at_once_are_those_put_together_by_level(spark, tmp_path, monkeypatch, lean):
    _tables(spark, tmp_path)
    made = lambda: sorted(map(tuple, mapping.feed_documents(spark, str(tmp_path), lean).collect()))
    at_once = made()
    assert len(at_once) == 11 and any("asteroids_19971228_19980103" in name for name, _ in at_once)
    full = F.date_format(F.to_date(F.regexp_extract("document", '"close_approach_date":"([^"]*)"', 1)), "yyyy-MMM-dd HH:mm")
    told = mapping.feed_documents(spark, str(tmp_path), lean).select(F.col("document").contains(full).alias("told")).collect()
    assert all(r["told"] for r in told)
    monkeypatch.setattr(mapping, "_joined", lambda parts: F.lit(None).cast("string"))
    assert made() == at_once


def test_documents_without_nulls_are_joined_at_once(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path)
    lines = spark.read.parquet(f"{tmp_path}/lineitem.parquet").filter("l_orderkey < 9 AND l_partkey < 3")
    lines.write.parquet(f"{tmp_path}/whole/lineitem.parquet")
    spark.read.parquet(f"{tmp_path}/part.parquet").write.parquet(f"{tmp_path}/whole/part.parquet")
    monkeypatch.setattr(mapping, "_json_object", lambda **fields: F.raise_error(F.lit("by level")).cast("string"))
    assert len(mapping.feed_documents(spark, f"{tmp_path}/whole").collect()) == lines.count() > 4
