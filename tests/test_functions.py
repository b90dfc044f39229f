import random
import uuid

import pytest
from pyspark.sql import functions as F

from perigee.functions import display, hazard, ids
from perigee.functions.numbers import fixed, is_finite, lenient_double, strict_double

NAN, INF = float("nan"), float("inf")


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("v"))).orderBy("i").collect()]


@pytest.mark.parametrize(
    "dmax, speed, au, pha, expected",
    [
        (0.3, 15.0, 0.04, True, "Critical"),
        (0.6, 5.0, 0.5, False, "High"),
        (0.05, 25.0, 0.08, False, "High"),
        (0.15, 5.0, 0.5, False, "Medium"),
        (0.05, 12.0, 0.5, False, "Medium"),
        (0.05, 5.0, 0.5, False, "Low"),
        (0.3, 15.0, 0.1, True, "Medium"),
        # every limit is strict
        (0.05, 5.0, 0.05, True, "Low"),
        (0.5, 5.0, 0.5, False, "Medium"),
        (0.1, 10.0, 0.5, False, "Low"),
        (0.05, 20.0, 0.01, False, "Medium"),
        (0.05, 21.0, 0.1, False, "Medium"),
        # what is not a number raises no class
        (NAN, NAN, NAN, True, "Low"),
        (NAN, 5.0, 0.04, True, "Critical"),
        (0.05, NAN, 0.01, False, "Low"),
        (INF, 5.0, 0.5, False, "High"),
    ],
)
def test_hazard_class(spark, dmax, speed, au, pha, expected):
    row = spark.createDataFrame([(dmax, speed, au, pha)], "d double, v double, a double, p boolean")
    got = row.select(hazard.classify_hazard(F.col("d"), F.col("v"), F.col("a"), F.col("p"))).first()
    assert got[0] == expected


def test_uuid5_matches_the_standard(spark):
    names = ["2496818", "REF123", "", "é漢", "x" * 300] + [str(n) for n in range(200)]
    space = uuid.UUID(ids.ASTEROID_NAMESPACE)
    assert column(spark, names, "string", ids.asteroid_id) == [str(uuid.uuid5(space, n)) for n in names]


def test_known_identifiers(spark):
    row = spark.range(1).select(
        ids.asteroid_id(F.lit("2496818")), ids.approach_id(F.lit("2496818"), F.lit(1764916440000))
    ).first()
    assert list(row) == [
        "cddf7cdf-3938-5068-b7d1-f98570a06a68",
        "8d43d0eb-18b0-5c40-b4fd-787779e82ee9",
    ]


@pytest.mark.parametrize("decimals", [0, 1, 2, 3])
def test_fixed_rounds_like_exact_printing(spark, decimals):
    rng = random.Random(7)
    values = [0.5, 1.5, 2.5, 0.25, 0.15, 1.005, 2.675, 0.125, 0.375, 1e-9, 0.0, 999.9995, 1234567.891]
    values += [n / 8 for n in range(400)] + [n / 1000 for n in range(0, 3000, 7)]
    values += [rng.uniform(0, 10 ** rng.randint(0, 9)) for _ in range(2000)]
    values += [-v for v in values if v >= 1]
    got = column(spark, values, "double", lambda c: fixed(c, decimals))
    assert got == [f"{v:.{decimals}f}" for v in values]


def test_fixed_without_a_number(spark):
    got = column(spark, [NAN, INF, -INF, None], "double", lambda c: fixed(c, 2))
    assert got == ["NaN", "inf", "-inf", None]


def test_lenient_double(spark):
    good = {"123.45": 123.45, "5": 5.0, "5.": 5.0, ".5": 0.5, "+1e3": 1000.0, "-2.5E-1": -0.25,
            "inf": INF, "-Infinity": -INF, "INF": INF}
    assert column(spark, list(good), "string", lenient_double) == list(good.values())
    bad = ["not-a-number", "[1,2]", " 1.5 ", "1.5 ", "1.5d", "1.5f", "", ".", "e5", "1e", "0x1p3",
           "true", "1.5\n", "1_000", "--1", None]
    assert column(spark, bad, "string", lenient_double) == [None] * len(bad)
    assert column(spark, ["NaN", "-nan"], "string", lambda c: F.isnan(lenient_double(c))) == [True] * 2


def test_strict_double_fails(spark):
    assert column(spark, ["1.5"], "string", strict_double) == [1.5]
    with pytest.raises(Exception, match="not a number: abc"):
        column(spark, ["abc"], "string", strict_double)


def test_is_finite(spark):
    got = column(spark, [1.0, NAN, INF, -INF, None], "double", is_finite)
    assert got == [True, False, False, False, False]


def test_format_number(spark):
    cases = {1500000.0: "1.50M", 1500.0: "1.5K", 500.0: "500", 999999.0: "1000.0K",
             1000.0: "1.0K", 999.5: "1000", 0.5: "0", -5.0: "-5", NAN: "NaN"}
    assert column(spark, list(cases), "double", display.format_number) == list(cases.values())


def test_texts(spark):
    assert column(spark, [5983914.8, 999999.4], "double", display.miss_distance_text) == [
        "5.98M km", "999999 km"]
    assert column(spark, [54000.5], "double", display.velocity_text) == ["54000 km/h"]
    assert column(spark, [0.1234], "double", display.diameter_text) == ["0.123 km"]
    assert column(spark, ["Critical", "High", "Medium", "Low", "odd"], "string",
                  display.hazard_colour) == [0xFF453A, 0xFF9F0A, 0xFFD60A, 0x30D158, 0x30D158]
    assert column(spark, ["2024-01-05", "2024-12-31"], "string",
                  lambda c: display.table_date(c.cast("date"))) == ["Jan  5, 2024", "Dec 31, 2024"]
    assert column(spark, [5.0, 5.1, 1.0, 1.1, NAN], "double", display.error_rate_class) == [
        "high", "critical", "low", "high", "low"]


def test_total_pages(spark):
    pages = lambda empty: column(spark, [0, 1, 20, 21], "bigint",
                                 lambda c: display.total_pages(c, 20, empty))
    assert pages(0) == [0, 1, 1, 2]
    assert pages(1) == [1, 1, 1, 2]
    with pytest.raises(ValueError):
        display.total_pages(F.lit(1), 0)


def test_vocabularies(spark):
    assert column(spark, ["Critical", "critical", "Hazardous", "Medium"], "string",
                  hazard.normalise_hazard) == ["Critical", "Low", "Low", "Medium"]
    assert column(spark, ["COMPLETED", "Failed", "running", "success"], "string",
                  hazard.normalise_status) == ["completed", "failed", "running", "running"]
    assert column(spark, ["Critical", "High", "Medium", "Low"], "string",
                  hazard.severity_rank) == [0, 1, 2, 3]
