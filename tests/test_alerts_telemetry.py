import datetime as dt
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from perigee import schemas
from perigee.operators import alerts, telemetry
from perigee.streaming import telemetry as live


@pytest.fixture(scope="module")
def sky(spark):
    ast = spark.createDataFrame(
        [("a", "A", "r1", True, 1.0), ("b", "B", "r2", False, 0.25)],
        "id string, name string, neo_reference_id string, is_potentially_hazardous boolean, "
        "estimated_diameter_avg_km double")
    rows = [("p1", "a", "2024-01-09", "Low"), ("p2", "a", "2024-01-10", "Low"),
            ("p3", "b", "2024-01-10", "Low"), ("p4", "b", "2024-01-12", "High"),
            ("p5", "b", "2024-01-11", "Critical"), ("p6", "b", "2024-01-11", "Hazardous"),
            ("p7", "b", "2024-01-11", "Medium"), ("p8", "a", "2024-01-13", "High")]
    ap = spark.createDataFrame(
        [(i, a, dt.date.fromisoformat(d), 5983914.8, 54000.0, h) for i, a, d, h in rows],
        "id string, asteroid_id string, close_approach_date date, miss_distance_km double, "
        "velocity_km_per_h double, hazard_classification string")
    sent = spark.createDataFrame(
        [("x", "p8", "discord", dt.datetime(2024, 1, 1), "{}"),
         ("y", "p4", "email", dt.datetime(2024, 1, 1), "{}")], schemas.ALERTS)
    return ap, ast, sent


def candidates(sky, **how):
    ap, ast, sent = sky
    return alerts.alert_candidates(ap, ast, sent, dt.date(2024, 1, 10), **how)


def test_candidates(sky):
    """Hazardous objects or classes, not yet alerted on this channel, from today on."""
    ids = lambda df: [r["approach_id"] for r in df.collect()]
    assert ids(candidates(sky)) == ["p2", "p5", "p6", "p4"]
    assert ids(candidates(sky, limit=2)) == ["p2", "p5"]
    assert ids(candidates(sky, channel="email")) == ["p2", "p5", "p6", "p8"]


def test_message(sky):
    rows = {r["approach_id"]: json.loads(r["message"])
            for r in alerts.alert_messages(candidates(sky)).collect()}
    urgent, calm = rows["p5"], rows["p2"]
    assert urgent["title"].endswith(" : B") and urgent["color"] == 0xFF453A
    assert "HIGH ALERT" in urgent["content"] and "Observation" in calm["content"]
    assert [f["value"] for f in urgent["fields"]] == [
        "**Critical**", "`2024-01-11`", "​", "`5.98M km`", "`54000 km/h`", "`0.250 km`"]
    assert all(f["inline"] for f in urgent["fields"])


def test_outbox_and_record(sky):
    ap, ast, sent = sky
    box = alerts.outbox(candidates(sky))
    assert {(r["alert_type"], r["delivered"]) for r in box.collect()} == {("discord", False)}
    at = dt.datetime(2024, 1, 10, 5)
    delivered = box.select("approach_id", "alert_type")
    fresh = alerts.record_alerts(sent, delivered.union(delivered).union(
        sent.select("approach_id", "alert_type")), at)
    rows = fresh.collect()
    assert sorted(r["approach_id"] for r in rows) == ["p2", "p4", "p5", "p6"]
    assert {(r["alerted_at"], r["payload"]) for r in rows} == {(at, '{"status":"sent"}')}
    assert len({r["id"] for r in rows}) == 4
    after = sent.unionByName(fresh)
    assert alerts.alert_candidates(ap, ast, after, dt.date(2024, 1, 10)).count() == 0
    assert alerts.record_alerts(after, delivered, at).count() == 0


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(2)
    begin = dt.datetime(2024, 1, 1)
    rows = [(begin + dt.timedelta(seconds=rng.randint(0, 1200)), rng.choice(["GET", "POST"]),
             rng.choice(["/a", "/b"]), rng.choice([200, 301, 399, 400, 404, 500, 599, 600]),
             rng.choice([0.001, 0.0009, 0.3, 11.0, 10.0, 0.25])) for _ in range(3000)]
    return rows, spark.createDataFrame(rows, schemas.HTTP_REQUESTS)


def test_histogram_is_cumulative(log):
    rows, df = log
    got = telemetry.histogram(df, telemetry.HTTP_LABELS, telemetry.HTTP_BUCKETS).collect()
    groups = {}
    for _, method, path, status, seconds in rows:
        groups.setdefault((method, path, status), []).append(seconds)
    assert len(got) == 13 * len(groups)
    for r in got:
        mine = groups[(r["method"], r["path"], r["status"])]
        limit = float("inf") if r["le"] == "+Inf" else float(r["le"])
        assert r["bucket_count"] == sum(s <= limit for s in mine)
        assert r["count"] == len(mine) and r["sum_s"] == pytest.approx(sum(mine))


def test_rates(log):
    rows, df = log
    minutes = {}
    for at, _, _, status, seconds in rows:
        minutes.setdefault(at.replace(second=0), []).append((status, seconds))
    for r in telemetry.http_rates(df).collect():
        mine = minutes.pop(r["window_start"])
        assert r["requests_per_second"] == len(mine) / 60
        errors = sum(400 <= s <= 599 for s, _ in mine)
        assert r["error_rate_percent"] == pytest.approx(errors / len(mine) * 100)
        assert r["avg_response_time_ms"] == pytest.approx(sum(s for _, s in mine) / len(mine) * 1000)
    assert not minutes


def test_summary_with_and_without_traffic(spark, log):
    rows, df = log
    ast = spark.createDataFrame([(True,), (False,)], "is_potentially_hazardous boolean")
    runs = spark.createDataFrame([], schemas.ETL_EVENTS)
    queries = df.select("ts", F.col("path").alias("operation"), F.lit("success").alias("status"), "duration_s")
    summary = lambda at: telemetry.metrics_summary(df, queries, ast, ast, runs, at)
    at = dt.datetime(2024, 1, 1, 0, 10)
    inside = [r for r in rows if at - dt.timedelta(minutes=1) < r[0] <= at]
    got = summary(at).first()
    assert got["requests_per_second"] == got["db_queries_per_second"] == len(inside) / 60
    assert (got["total_asteroids"], got["total_approaches"], got["hazardous_count"]) == (2, 2, 1)
    quiet = summary(dt.datetime(2025, 1, 1)).first()
    assert tuple(quiet)[:4] == (0.0, 0.0, 0.0, 0.0) and quiet["last_etl_run"] is None
    shown = telemetry.metric_texts(summary(dt.datetime(2025, 1, 1))).first()
    assert tuple(shown) == ("0.000", "0.000%", "low", "0.000 ms", "0.000")


def stream_of(spark, df, folder):
    df.repartition(3).write.parquet(folder)
    return live.log_stream(spark, folder, schemas.HTTP_REQUESTS)


def test_streamed_totals_equal_batch(spark, log, tmp_path):
    _, df = log
    stream = stream_of(spark, df, str(tmp_path / "log"))
    key = lambda frame: sorted(map(tuple, frame.collect()))
    for name, make, batch in (
        ("totals", live.live_request_totals, telemetry.counter(df, telemetry.HTTP_LABELS)),
        ("buckets", live.live_request_histogram,
         telemetry.histogram(df, telemetry.HTTP_LABELS, telemetry.HTTP_BUCKETS)),
    ):
        seen = []
        write = lambda frame, _: seen.append(key(frame.drop("sum_s")))
        live.replace_with(make(stream), write, str(tmp_path / f"c-{name}")).awaitTermination()
        assert seen[-1] == key(batch.drop("sum_s"))


def test_streamed_rates_have_late_rows_and_the_last_minute(spark, log, tmp_path):
    rows, df = log
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    first = min(r[0] for r in rows)
    late = df.filter(F.col("ts") < F.lit(first + dt.timedelta(minutes=2)))
    df.join(late.select("ts"), "ts", "left_anti").select(*df.columns).repartition(3).write.parquet(folder)
    run = lambda: live.add_up(
        live.log_stream(spark, folder, schemas.HTTP_REQUESTS), telemetry.http_minutes, out, str(tmp_path / "c")
    ).awaitTermination()
    run()
    late.write.mode("append").parquet(folder)  # long after everything else
    run()
    key = lambda frame: {r["window_start"]: tuple(round(x, 9) for x in r[1:]) for r in frame.collect()}
    assert late.count() and key(live.http_rates(spark, out)) == key(telemetry.http_rates(df))


def test_closed_days_hold_all_batches(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + day, hour), "GET", "/a", 500 if hour % 2 else 200, 0.25 * (hour + 1))
            for day in range(4) for hour in range(0, 24, 3)]
    folder, out, place = tmp_path / "log", str(tmp_path / "out"), tmp_path / "out"
    whole = spark.createDataFrame(rows, schemas.HTTP_REQUESTS)
    key = lambda frame: {r["window_start"]: tuple(round(x, 9) for x in r[1:]) for r in frame.collect()}

    def step(number, part):
        spark.createDataFrame(part, schemas.HTTP_REQUESTS).coalesce(1).write.mode("append").parquet(str(folder))
        stream = live.log_stream(spark, str(folder), schemas.HTTP_REQUESTS)
        live.add_up(stream, telemetry.http_minutes, out, str(tmp_path / "c")).awaitTermination()

    days = lambda: {p.name: sorted(x.name for x in p.iterdir() if x.is_dir()) for p in place.iterdir() if p.is_dir()}
    for number in range(3):  # the last batch brings late rows of the first day
        step(number, rows[number::4])
        live.close_days(spark, out, dt.date(2024, 1, 3))
        assert days()["day=2024-01-01"] == days()["day=2024-01-02"] == ["batch=-1"]
        assert len(days()["day=2024-01-04"]) == number + 1
    step(3, rows[3::4])
    assert len(days()["day=2024-01-01"]) == 2 and key(live.http_rates(spark, out)) == key(telemetry.http_rates(whole))
    # a closing that ended before it removed what it had summed up
    kept = tmp_path / "kept"
    shutil.copytree(place / "day=2024-01-01" / "batch=3", kept)
    live.close_days(spark, out, dt.date(2024, 1, 5))
    shutil.copytree(kept, place / "day=2024-01-01" / "batch=3")
    live.close_days(spark, out, dt.date(2024, 1, 5))
    assert all(held == ["batch=-1"] for held in days().values())
    assert key(live.http_rates(spark, out)) == key(telemetry.http_rates(whole))


def test_query_log_streams(spark, log, tmp_path):
    _, df = log
    queries = df.select("ts", F.col("path").alias("operation"), F.lit("success").alias("status"), "duration_s")
    folder = str(tmp_path / "q")
    queries.write.parquet(folder)
    stream = live.log_stream(spark, folder, schemas.DB_QUERIES)
    seen = []
    write = lambda frame, _: seen.append(sorted(map(tuple, frame.collect())))
    live.replace_with(live.live_query_totals(stream), write, str(tmp_path / "c1")).awaitTermination()
    assert seen[-1] == sorted(map(tuple, telemetry.counter(queries, telemetry.DB_LABELS).collect()))
    assert live.live_query_histogram(stream).isStreaming
    out = str(tmp_path / "minutes")
    live.add_up(stream, telemetry.db_minutes, out, str(tmp_path / "c2")).awaitTermination()
    assert sorted(map(tuple, live.db_rates(spark, out).collect())) == sorted(map(tuple, telemetry.db_rates(queries).collect()))
