import datetime as dt
import json

import pytest
from feeds import approach, documents, feed, neo
from pyspark.sql import functions as F

from perigee import schemas
from perigee.operators import alerts
from perigee.plans import alerting, extract, load, transform
from perigee.sources import batches, records, tables
from perigee.streaming.loading import load_stream

AT = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
LATER = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
DAY_MS = 86400000


def write_raw(folder, name, days):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(feed(days), indent=2))


def snapshot(spark, root, table):
    df = tables.read_table(spark, root, table)
    return sorted(map(tuple, df.select(*schemas.TABLES[table].names).collect()), key=str)


@pytest.fixture
def places(tmp_path):
    raw = tmp_path / "raw"
    write_raw(raw, "one.json", {
        "2024-01-01": [neo("A"), neo("B", approaches=[])],
        "2024-01-02": [neo("A", approaches=[approach(epoch=1704067200000 + DAY_MS, date="2024-01-02")])]})
    write_raw(raw, "two.json", {"2024-01-01": [neo("A"), neo("C", pha=False, approaches=[
        approach(epoch=1704067200000 + 60 * DAY_MS, date="2024-03-01")])]})
    (raw / "_metadata.json").write_text("{}")
    return str(raw), str(tmp_path / "records"), str(tmp_path / "tables"), tmp_path


def test_from_files_to_alerts(spark, places):
    raw, out, root, tmp = places
    assert transform.plan_transform(spark, raw, out).count() == 2
    transform.run_transform(spark, raw, out, AT)
    assert transform.plan_transform(spark, raw, out).count() == 0
    assert transform.plan_transform(spark, raw, out, force=True).count() == 2

    assert load.plan_load(spark, out, root).count() >= 2
    assert tables.read_table(spark, root, "etl_events").isEmpty()
    summary = load.run_load(spark, out, root, at=AT).first()
    # the approach both files list enters once
    assert tuple(summary) == (2, 0, 4, 3, 1)
    assert [r[1] for r in sorted(snapshot(spark, root, "asteroids"), key=lambda r: r[1])] == ["A", "B", "C"]
    assert len(snapshot(spark, root, "approaches")) == 3
    book = {r[1]: r[4:] for r in snapshot(spark, root, "etl_events")}
    assert book == {"one_transformed.json": ("completed", 2, 2, None),
                    "two_transformed.json": ("completed", 2, 1, None)}

    # a second load finds nothing to do, a forced one changes nothing but the ledger times
    assert load.run_load(spark, out, root, at=LATER) is None
    before = {name: snapshot(spark, root, name) for name in ("asteroids", "approaches")}
    assert tuple(load.run_load(spark, out, root, force=True, at=LATER).first()) == (2, 0, 4, 0, 4)
    assert before == {name: snapshot(spark, root, name) for name in before}
    assert {r[2] for r in snapshot(spark, root, "etl_events")} == {LATER.replace(tzinfo=None)}

    # alerts: hazardous and upcoming only, once per channel
    box = alerting.write_outbox(spark, root, str(tmp / "outbox"), dt.date(2024, 1, 2))
    assert box.count() == 2
    alerting.record_deliveries(spark, root, box.limit(1).select("approach_id", "alert_type"), LATER)
    assert len(snapshot(spark, root, "alerts")) == 1
    rest = alerting.write_outbox(spark, root, str(tmp / "outbox2"), dt.date(2024, 1, 2))
    assert rest.count() == 1
    assert {r["delivered"] for r in rest.collect()} == {False}


def test_new_values_and_old_identity(spark, places):
    raw, out, root, tmp = places
    transform.run_transform(spark, raw, out, AT)
    load.run_load(spark, out, root, at=AT)
    more = tmp / "raw"
    write_raw(more, "three.json", {"2024-01-03": [neo("A", name="renamed", pha=False, low=0.01, high=0.02)]})
    transform.run_transform(spark, raw, out, LATER)
    summary = load.run_load(spark, out, root, at=LATER).first()
    assert tuple(summary) == (1, 2, 1, 0, 1)
    a = [r for r in snapshot(spark, root, "asteroids") if r[1] == "A"][0]
    assert a[2] == "renamed" and a[6] is False and a[9] == AT.replace(tzinfo=None)
    assert a[10] == LATER.replace(tzinfo=None) and a[11] == pytest.approx(0.015)
    # the stored approach keeps the class it was given
    classes = {r[10] for r in snapshot(spark, root, "approaches") if r[1] == a[0]}
    assert classes == {"Critical"}


def test_files_fail_alone(spark, tmp_path):
    folder, root = tmp_path / "records", str(tmp_path / "tables")
    folder.mkdir()
    good = records.encode_records(transform.transform_feed(documents(spark, feed()), AT)).first()["value"]
    (folder / "good_transformed.json").write_text(f"{good}\n\nbroken\n  {good}  \n")
    (folder / "bad_transformed.json").write_text("broken\n\n")
    (folder / "empty_transformed.json").write_text("")
    (folder / "other.json").write_text(good)
    summary = load.run_load(spark, str(folder), root, at=AT).first()
    assert tuple(summary) == (1, 0, 1, 1, 1)
    book = {r[1]: (r[4], r[7]) for r in snapshot(spark, root, "etl_events")}
    lost = ("failed", "No valid records found in file")
    assert book == {"good_transformed.json": ("completed", None), "bad_transformed.json": lost,
                    "empty_transformed.json": lost}
    # failed files are tried again
    (folder / "bad_transformed.json").write_text(good)
    assert tuple(load.run_load(spark, str(folder), root, at=LATER).first())[:2] == (1, 1)
    assert {r[1]: r[4] for r in snapshot(spark, root, "etl_events")}["bad_transformed.json"] == "completed"


def test_a_bad_document_stops_a_strict_transform(spark, places):
    raw, out, root, tmp = places
    (tmp / "raw" / "zero.json").write_text('{"error": {}}')
    with pytest.raises(Exception, match="cannot read zero.json"):
        transform.run_transform(spark, raw, out, AT)
    (tmp / "raw" / "zero.json").write_text("")
    with pytest.raises(Exception, match="cannot read zero.json"):
        transform.run_transform(spark, raw, out, AT)
    with pytest.raises(ValueError, match="folder for rejected"):
        transform.run_transform(spark, raw, out, AT, strict=False)
    (tmp / "raw" / "bad.json").write_text('{"links": 1}')
    gone = str(tmp / "rejects")
    read = transform.run_transform(spark, raw, out, AT, strict=False, rejects=gone)
    assert {r["source_file"]: r["rejected_documents"] for r in read.collect()} == {
        "one.json": 0, "two.json": 0, "zero.json": 1, "bad.json": 1}
    assert {r["source_file"] for r in spark.read.parquet(gone).collect()} == {"zero.json", "bad.json"}
    assert load.run_load(spark, out, root, at=AT).first()["files_processed"] == 2


def test_a_broken_load_is_repeated(spark, places, monkeypatch):
    raw, out, root, tmp = places
    transform.run_transform(spark, raw, out, AT)
    whole = str(tmp / "whole")
    load.run_load(spark, out, whole, at=AT)
    rewrite = tables.rewrite
    for broken in ("asteroids", "etl_events"):
        def fail(rows, place, table):
            if table == broken:
                raise OSError("lost")
            rewrite(rows, place, table)

        monkeypatch.setattr(tables, "rewrite", fail)
        with pytest.raises(OSError):
            load.run_load(spark, out, root, at=AT)
        assert tables.read_table(spark, root, "etl_events").isEmpty()
    monkeypatch.setattr(tables, "rewrite", rewrite)
    assert load.run_load(spark, out, root, at=AT).first()["files_processed"] == 2
    for table in ("asteroids", "approaches"):
        assert snapshot(spark, root, table) == snapshot(spark, whole, table)
    assert {r[4] for r in snapshot(spark, root, "etl_events")} == {"completed"}


def test_loads_rewrite_only_what_they_touch(spark, tmp_path):
    folder, root = tmp_path / "records", str(tmp_path / "tables")
    folder.mkdir()
    tables.ensure_tables(spark, root)
    tables.ensure_tables(spark, root)
    assert all(tables.read_table(spark, root, name).isEmpty() for name in schemas.TABLES)

    def step(number):
        items = [approach(epoch=1704067200000 + number * DAY_MS)]
        line = records.encode_records(transform.transform_feed(documents(spark, feed({"d": [neo(f"N{number}", approaches=items)]})), AT)).first()
        (folder / f"f{number}_transformed.json").write_text(line["value"])
        return load.run_load(spark, str(folder), root, at=AT)

    def files():
        return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "tables" / "asteroids").rglob("*.parquet")}

    step(0)
    before, plan = files(), None
    for number in range(1, 4):
        assert tuple(step(number).first()) == (1, number, 1, 1, 0)
        after = files()
        assert len(set(after) - set(before)) == 1 and len(set(before) - set(after)) <= 1
        before = after
        shown = [tables.read_table(spark, root, t)._jdf.queryExecution().executedPlan().toString() for t in schemas.TABLES]
        assert all(s.count("FileScan") == 1 and "Aggregate" not in s for s in shown)
        assert plan is None or [len(s) for s in shown] == plan
        plan = [len(s) for s in shown]
    assert len(snapshot(spark, root, "asteroids")) == 4 and len(snapshot(spark, root, "etl_events")) == 4


def test_streamed_load_equals_batch_load(spark, places):
    raw, out, root, tmp = places
    write_raw(tmp / "raw", "three.json", {"2024-01-03": [neo("A", name="renamed"), neo("D")]})
    transform.run_transform(spark, raw, out, AT)
    (tmp / "records" / "bad_transformed.json").write_text("broken")
    (tmp / "records" / "bare_transformed.json").write_text("")
    load.run_load(spark, out, root, at=AT)
    live, checkpoint = str(tmp / "live"), str(tmp / "checkpoint")
    load_stream(spark, out, live, checkpoint, files_per_batch=1).awaitTermination()
    ids = lambda place, table: [r[0] for r in snapshot(spark, place, table)]
    for table in ("asteroids", "approaches"):
        assert ids(live, table) == ids(root, table)
    state = lambda place: {r[1]: r[4] for r in snapshot(spark, place, "etl_events")}
    assert state(live) == state(root) and state(live)["bare_transformed.json"] == "failed"
    # nothing new: nothing happens, also with the checkpoint lost
    load_stream(spark, out, live, checkpoint).awaitTermination()
    load_stream(spark, out, live, str(tmp / "other")).awaitTermination()
    assert ids(live, "approaches") == ids(root, "approaches")
    assert state(live) == state(root)


def test_extraction(spark, tmp_path):
    planned = batches.plan_batches(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 28), 7)
    names = [r["batch_file"] for r in planned.orderBy("batch_number").collect()]
    landed = spark.createDataFrame([(names[0],)], "batch_file string")
    docs = spark.createDataFrame(
        [(names[1], json.dumps(feed({"d": [neo("A"), neo("B")], "e": [neo("C")]}))),
         (names[1], "{"), (names[2], '{"error": 1}'), (names[0], json.dumps(feed()))],
        "source_file string, document string")
    folder = str(tmp_path / "raw")
    results = extract.land_batches(planned, landed, docs, folder, str(tmp_path / "meta"), at=AT)
    state = {r["batch_file"]: (r["status"], r["objects"]) for r in results.collect()}
    assert {r["batch_file"]: r["unreadable"] for r in results.collect()} == {
        names[0]: 0, names[1]: 1, names[2]: 1, names[3]: 0}
    assert state == {names[0]: ("skipped", 0), names[1]: ("extracted", 3),
                     names[2]: ("failed", 0), names[3]: ("failed", 0)}
    assert tuple(extract.extraction_summary(results).first())[2:] == (3, 4, 2, 2)
    meta = spark.read.json(str(tmp_path / "meta")).first().asDict()
    assert meta == {"start_date": "2024-01-01", "end_date": "2024-01-28", "total_asteroids": 3,
                    "extracted_at": "2024-01-01T00:00:00Z", "total_batches": 4,
                    "nasa_api_version": "v1"}
    assert extract.pending_batches(planned, landed, force=True).count() == 4


def test_transform_summary(spark):
    docs = documents(spark, feed({"d": [neo("A"), neo("A"), neo("B", approaches=[])]}), feed())
    files = spark.createDataFrame([("f0.json",), ("f1.json",)], "source_file string")
    nothing, second = files.limit(0), files.filter("source_file = 'f1.json'")
    summary = lambda done: tuple(transform.transform_summary(
        docs, files, done).select(
        "files_processed", "files_skipped", "total_asteroids", "total_approaches",
        "critical_count", "low_count").first())
    assert summary(nothing) == (2, 0, 4, 3, 3, 0)
    assert summary(second) == (1, 1, 3, 2, 2, 0)


def test_alert_constants():
    assert alerts.BATCH == 100 and alerts.CHANNEL == "discord"


def test_one_chain_from_extract_to_tables(spark, tmp_path):
    """Folders go from step to step as they are; a second round finds nothing to do."""
    planned = batches.plan_batches(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 21), 7)
    names = [r["batch_file"] for r in planned.orderBy("batch_number").collect()]
    docs = spark.createDataFrame(
        [(names[0], json.dumps(feed({"2024-01-01": [neo("A"), neo("B", approaches=[])]}))),
         (names[1], json.dumps(feed({}))),
         (names[2], json.dumps(feed({"2024-01-15": [neo("A", name="renamed")]}), indent=1))],
        "source_file string, document string")
    nothing = spark.createDataFrame([], "batch_file string")
    raw, out = str(tmp_path / "raw"), str(tmp_path / "records")
    extract.land_batches(planned, nothing, docs, raw, str(tmp_path / "meta"), at=AT)
    read = transform.run_transform(spark, raw, out, AT)
    assert sorted({r["source_file"] for r in read.collect()}) == names
    assert transform.plan_transform(spark, raw, out).count() == 0
    batch, live = str(tmp_path / "batch"), str(tmp_path / "live")
    assert tuple(load.run_load(spark, out, batch, at=AT).first())[:3] == (2, 0, 3)
    load_stream(spark, out, live, str(tmp_path / "checkpoint")).awaitTermination()
    for table in ("asteroids", "approaches"):
        assert [r[:9] for r in snapshot(spark, live, table)] == [r[:9] for r in snapshot(spark, batch, table)]
    state = lambda place: {r[1]: (r[4:]) for r in snapshot(spark, place, "etl_events")}
    assert state(live) == state(batch)
    assert state(batch)[names[1].replace(".json", "_transformed.json")][0] == "failed"
    assert load.plan_load(spark, out, batch).select("source_file").distinct().count() == 1
    for call in (lambda: transform.run_transform(spark, out, raw), lambda: load.run_load(spark, raw, batch),
                 lambda: load_stream(spark, raw, live, str(tmp_path / "c2"))):
        with pytest.raises(ValueError, match="none of the kind"):
            call()


def test_every_instant_loads_and_keys_stay_unique(spark, tmp_path):
    root = str(tmp_path / "tables")
    far = [2**63 - 1, -(2**63), 0, -1, 253402300800000, 1704067200000, 1704067200000 + 40 * DAY_MS]
    for number in (1, 2, 3):
        folder = tmp_path / f"records{number}"
        folder.mkdir()
        items = [approach(epoch=e, date="9999-12-31" if e > 1e14 else "2024-01-01") for e in far[: 2 * number + 1]]
        docs = documents(spark, feed({"d": [neo("A", approaches=items), neo(f"N{number}")]}))
        lines = records.encode_records(transform.transform_feed(docs, AT)).collect()
        (folder / f"f{number}_transformed.json").write_text("\n".join(r["value"] for r in lines))
        load.run_load(spark, str(folder), root, at=AT)
    keys = [(r[1], r[3]) for r in snapshot(spark, root, "approaches")]
    a = [r[0] for r in snapshot(spark, root, "asteroids") if r[1] == "A"][0]
    assert len(keys) == len(set(keys)) and sorted(e for k, e in keys if k == a) == sorted(far)


def test_date_reads_prune_partitions_and_deletes_are_stored(spark, places):
    from perigee.operators import reads

    raw, out, root, _ = places
    transform.run_transform(spark, raw, out, AT)
    load.run_load(spark, out, root, at=AT)
    ap, ast = (tables.read_table(spark, root, t) for t in ("approaches", "asteroids"))
    wanted = reads.ApproachFilter(dt.date(2024, 3, 1), dt.date(2024, 3, 31))
    for page in (reads.approaches_page(ap, ast, wanted), reads.velocity(ap, ast, start=dt.date(2024, 3, 1)),
                 reads.velocity(ap, ast, reads.Period.MONTH, as_of=dt.datetime(2024, 3, 5)),
                 alerts.alert_candidates(ap, ast, tables.read_table(spark, root, "alerts"), dt.date(2024, 3, 1))):
        plan = page._jdf.queryExecution().executedPlan().toString()
        filters = [x for x in plan.split("PartitionFilters: [")[1:] if x.split("]")[0]]
        assert any("date_month" in x.split("]")[0] for x in filters)
    assert reads.approaches_page(ap, ast, wanted).count() == 1
    gone = ast.filter("neo_reference_id = 'A'").select("id")
    load.delete_asteroids(spark, root, gone)
    assert [r[1] for r in snapshot(spark, root, "asteroids")] == ["B", "C"]
    assert len(snapshot(spark, root, "approaches")) == 1
    # what was deleted can be loaded again
    load.run_load(spark, out, root, force=True, at=LATER)
    assert len(snapshot(spark, root, "asteroids")) == 3 and len(snapshot(spark, root, "approaches")) == 3
