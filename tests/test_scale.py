"""What keeps the cost of feed documents in proportion to their number."""

import datetime as dt
import json

from feeds import approach, documents, feed, neo
from pyspark.sql import functions as F

from perigee.functions import ids
from perigee.plans import load, transform
from perigee.sources import batches, records
from perigee.sources import feed as source
from perigee.streaming import loading
from workload import mapping, queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_landed_and_record_files_are_compressed(spark, tmp_path):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    docs = documents(spark, feed(), feed({"2024-01-02": [neo("B", approaches=[approach(), approach(epoch=5)])]}))
    day = F.lit(dt.date(2024, 1, 1))
    source.land(docs.withColumns({"batch_start": day, "batch_end": F.date_add(day, 6)}), str(tmp_path / "raw"))
    records.write_records(transform.transform_feed(docs), str(tmp_path / "records"))
    for folder in ("raw", "records"):
        names = [p.name for p in (tmp_path / folder).rglob("part-*")]
        assert names and all(name.endswith(".gz") for name in names)
    assert spark.conf.get(key) == before
    assert source.read_landed(spark, str(tmp_path / "raw")).count() == 2
    lines = records.scan_record_partitions(spark, str(tmp_path / "records"))
    assert {r["state"] for r in records.decode_records(lines).collect()} == {"valid"}


def test_documents_are_not_shuffled_to_leave_files_out(spark):
    docs = documents(spark, feed(), feed())
    # a grouping has no known size, so that without more ado the join is planned as a sort-merge join
    done = docs.filter("source_file = 'f1.json'").groupBy("source_file").count()
    rest = batches.pending(docs, done, "source_file")
    assert "SortMergeJoin" not in plan_of(rest)
    assert [r["source_file"] for r in rest.collect()] == ["f0.json"]


def test_hashes_of_identifiers_are_made_once(spark):
    objects = source.feed_objects(source.valid_feeds(source.decode_feed(documents(spark, feed()))))
    now = F.lit(None).cast("timestamp")
    assert plan_of(source.approach_rows(objects, now)).count("sha1(") == 2
    assert plan_of(source.asteroid_rows(objects, now)).count("sha1(") == 1


def _tables(spark, folder):
    lines = [(1, 1, 7, 3, 10.0, 0.02, 0.01), (2, 2, 7, None, None, 0.5, None), (4, 1, 8, 5, 44.0, 0.0, 0.0)]
    items = spark.createDataFrame(
        lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_discount double, l_tax double"
    ).withColumn("l_shipdate", F.lit(dt.datetime(1998, 1, 2)).cast("timestamp_ntz"))
    items.write.parquet(f"{folder}/lineitem.parquet")
    parts = [(7, 'odd "name"\\', 16, 939.1), (8, None, None, None)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_size int, p_retailprice double").write.parquet(
        f"{folder}/part.parquet"
    )


def test_documents_are_dealt_out_after_the_join(spark, tmp_path):
    _tables(spark, tmp_path)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = plan_of(mapping.feed_documents(spark, str(tmp_path)))
    finally:
        spark.conf.set(key, before)
    assert -1 < plan.index("RoundRobinPartitioning") < plan.index("SortMergeJoin")


def test_documents_leave_out_nulls_and_escape_names(spark, tmp_path):
    _tables(spark, tmp_path)
    made = mapping.feed_documents(spark, str(tmp_path)).select(
        "document", F.from_json("document", source.schemas.FEED, source.JSON_OPTIONS).alias("feed")
    ).collect()
    assert len(made) == 3
    by_name = {r["feed"]["near_earth_objects"]["1998-01-02"][0]["name"]: r for r in made}
    assert set(by_name) == {'odd "name"\\ 7', None}
    bare = by_name[None]["document"]
    assert '"name":null' not in bare and '"estimated_diameter":{"kilometers":{},"meters":{}' in bare
    assert '"kilometers_per_second":22.0' in bare  # even orders carry numbers
    assert any('"relative_velocity":{}' in r["document"] for r in made)
    assert any('"kilometers_per_second":"5.0"' in r["document"] for r in made)


def _streamed(spark, tmp_path, docs):
    lines = str(tmp_path / "records")
    records.write_records(transform.transform_feed(docs, dt.datetime(2024, 1, 1)), lines)
    return loading.load_stream(spark, lines, str(tmp_path / "tables"), str(tmp_path / "checkpoint"))


def test_transforms_and_loads_keep_no_decoded_frames(spark, tmp_path, monkeypatch):
    raw, out, root = tmp_path / "raw", str(tmp_path / "records"), tmp_path / "tables"
    raw.mkdir()
    for name, text in {"a": json.dumps(feed()), "b": json.dumps(feed({})), "c": '{"links": 1}', "d": ""}.items():
        (raw / f"{name}.json").write_text(text)

    def fail(*_):
        raise AssertionError("a frame is kept")

    monkeypatch.setattr(type(spark.range(1)), "persist", fail)
    read = transform.run_transform(spark, str(raw), out, dt.datetime(2024, 1, 1), strict=False, rejects=str(tmp_path / "rejects"))
    assert {r["source_file"]: r["rejected_documents"] for r in read.collect()} == {
        "a.json": 0, "b.json": 0, "c.json": 1, "d.json": 1}
    lines = records.decode_records(records.scan_record_partitions(spark, out)).collect()
    assert sorted((r["source_file"], r["state"]) for r in lines) == [
        ("a_transformed.json", "valid"), ("b_transformed.json", "blank")]
    assert tuple(load.run_load(spark, out, str(root)).first()) == (1, 0, 1, 1, 0)
    assert {p.name for p in root.iterdir()} == {"asteroids", "approaches", "etl_events", "_counted"}


def test_a_stream_does_not_shuffle_its_lines(spark, tmp_path, monkeypatch):
    plans, key = [], "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    monkeypatch.setattr(loading, "commit", lambda spark, root, files, lines, *_: plans.append(plan_of(lines)))
    spark.conf.set(key, "-1")
    try:
        _streamed(spark, tmp_path, documents(spark, feed())).awaitTermination()
    finally:
        spark.conf.set(key, before)
    # what is below are the names of files, which are joined as they like
    assert len(plans) == 1 and plans[0].split("\n")[1].startswith("+- BroadcastHashJoin")


def test_packed_identifiers_come_back(spark):
    uuid = "0f8fad5b-d9cb-569f-a165-70867728950e"
    texts = [uuid, uuid.upper(), uuid + "\n", uuid[1:], "a", "", "\x00" * 16, "é" * 8, None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ids.packed_uuid(F.col("t")).alias("p"))
    rows = frame.select("t", "p", ids.unpacked_uuid(F.col("p")).alias("back")).collect()
    assert [r["back"] for r in rows] == texts
    assert len(rows[0]["p"]) == 17 and len({r["p"] for r in rows}) == len(texts)


def test_incoming_sightings_meet_their_part_after_they_are_chosen(spark, tmp_path):
    """Columns that only rows to add need are not moved for all that come in."""
    day = lambda d: dt.datetime(1998, 1, d)
    lines = [  # the copies of one key differ in their distance only, those of another in their order
        (4, 1, 8, 5, 44.0, 0.03, 0.0, day(2)), (4, 1, 8, 5, 44.0, 0.0, 0.02, day(2)),
        (3, 2, 8, 5, 10.0, 0.5, 0.0, day(3)), (3, 1, 8, 5, 44.0, 0.5, 0.0, day(3)), (3, 3, 8, 5, None, None, 0.0, day(3)),
        (1, 1, 9, 5, 44.0, 0.0, 0.0, day(2)), (2, 1, None, 5, 44.0, 0.0, 0.0, day(2)),
        (5, 1, 10, 5, 44.0, 0.01, 0.0, dt.datetime(1996, 5, 1)), (5, 1, 10, 6, 44.0, 0.01, 0.0, day(4)),
    ]
    spark.createDataFrame(
        lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp_ntz"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(8, 1), (8, None), (10, 20), (10, 80), (10, 80)], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        merged = queries.REGISTRY["upsert_approaches"](spark, str(tmp_path))
        plan = plan_of(merged)
    finally:
        spark.conf.set(key, before)
    assert -1 < plan.index("Inner") < plan.index("LeftAnti")
    rows = {(r["close_approach_date"], r["velocity_km_per_h"], r["miss_distance_astronomical"], r["hazard_classification"])
            for r in merged.collect()}
    assert rows == {
        ("1998-01-02", 79200.0, 0.02, "High"), ("1998-01-03", 79200.0, 0.5, "Medium"),
        ("1996-05-01", 79200.0, 0.01, "Low"), ("1998-01-04", 79200.0, 0.01, "Critical"),
    }
    got = merged.select("id", "asteroid_id", "epoch_date_close_approach")
    wanted = got.select(
        ids.approach_id(ref := F.when(F.col("epoch_date_close_approach").isin(883699200000, 883785600000), "8").otherwise("10"),
                        F.col("epoch_date_close_approach")),
        ids.asteroid_id(ref), "epoch_date_close_approach")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_parsed_documents_and_lines_are_not_copied_between_steps(spark):
    docs = documents(spark, feed(), feed({"2024-01-02": [neo("B", approaches=[])]}), "{ broken", "")
    decoded = source.decode_feed(docs)
    assert plan_of(decoded).count("Generate inline") == 1
    assert [r["decode_error"] is None for r in decoded.orderBy("source_file").collect()] == [True, True, False, False]
    line = records.encode_records(transform.transform_feed(documents(spark, feed()))).first()["value"]
    texts = {"valid": [line, f" \t{line}", f"{line}\r\n"], "blank": ["", " \t\x0b"],
             "malformed": [line[:-1], f"{line[:-1]},1]", "[]", "]", "[", f" {line}"]}
    lines = spark.createDataFrame([(state, text) for state, each in texts.items() for text in each], "source_file string, value string")
    assert plan_of(records.decode_records(lines)).count("Generate inline") == 1
    assert all(r["state"] == r["source_file"] for r in records.decode_records(lines).collect())
