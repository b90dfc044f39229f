import datetime as dt
import random

from perigee import schemas
from perigee.operators import ledger, merge
from perigee.operators.shape import keep_first

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def asteroid(ref, name, at=T0, low=1.0, high=3.0):
    return (f"id-{ref}-{name}", ref, name, 20.0, low, high, False, False, "u", at, at, None)


def asteroids(spark, rows, listing=None):
    if listing is None:
        return spark.createDataFrame(rows, schemas.ASTEROIDS)
    schema = schemas.T.StructType(schemas.ASTEROIDS.fields + [
        schemas.T.StructField("listing", schemas.T.IntegerType())])
    return spark.createDataFrame([r + (n,) for r, n in zip(rows, listing)], schema)


def test_keep_first_and_last(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 20), rng.randint(0, 9), rng.randint(0, 9), str(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, o int, p int, v string")
    first = {k: min((o, p, v) for kk, o, p, v in rows if kk == k) for k, *_ in rows}
    last = {k: max((o, p, v) for kk, o, p, v in rows if kk == k) for k, *_ in rows}
    got = lambda **how: {r[0]: tuple(r[1:]) for r in keep_first(df, ["k"], ["o"], **how).collect()}
    assert got() == first
    assert got(last=True) == last


def test_upsert_keeps_identity_and_creation(spark):
    existing = asteroids(spark, [asteroid("A", "old"), asteroid("B", "old")])
    incoming = asteroids(
        spark,
        [asteroid("A", "first", T1), asteroid("A", "second", T1, 2.0, 4.0), asteroid("C", "new", T1)],
        [1, 2, 1],
    )
    rows = {r["neo_reference_id"]: r for r in
            merge.upsert_asteroids(existing, incoming, ["listing"]).collect()}
    assert set(rows) == {"A", "B", "C"}
    a = rows["A"]
    assert (a["id"], a["name"], a["created_at"], a["updated_at"]) == ("id-A-old", "second", T0, T1)
    assert a["estimated_diameter_avg_km"] == 3.0
    assert (rows["B"]["name"], rows["B"]["updated_at"]) == ("old", T0)
    assert (rows["C"]["id"], rows["C"]["created_at"]) == ("id-C-new", T1)


def test_upsert_twice_changes_only_nothing(spark):
    existing = asteroids(spark, [asteroid("A", "old")])
    incoming = asteroids(spark, [asteroid("A", "x", T1), asteroid("B", "y", T1)], [1, 1])
    once = merge.upsert_asteroids(existing, incoming, ["listing"])
    twice = merge.upsert_asteroids(once, incoming, ["listing"])
    assert sorted(once.collect()) == sorted(twice.collect())


def approaches(spark, rows):
    return spark.createDataFrame(
        rows, "asteroid_id string, epoch_date_close_approach bigint, hazard_classification string, n int")


def test_stored_approach_wins_and_first_copy_enters(spark):
    existing = approaches(spark, [("a", 1, "Low", 0)])
    incoming = approaches(spark, [("a", 1, "High", 1), ("a", 2, "High", 3), ("a", 2, "Low", 2)])
    rows = sorted(map(tuple, merge.upsert_approaches(existing, incoming, ["n"]).collect()))
    assert rows == [("a", 1, "Low", 0), ("a", 2, "Low", 2)]
    bounded = merge.new_approaches(existing, incoming, ["n"]).collect()
    assert [tuple(r) for r in bounded] == [("a", 2, "Low", 2)]


def test_upsert_stats(spark):
    rng = random.Random(5)
    stored_refs = [str(i) for i in range(30)]
    listed = [str(rng.randint(0, 60)) for _ in range(300)]
    stored = [(r, rng.randint(0, 5)) for r in stored_refs]
    seen = [(r, rng.randint(0, 5)) for r in listed]
    to_events = lambda rows: approaches(spark, [(r, e, "Low", 0) for r, e in rows])
    refs = lambda names: spark.createDataFrame([(n,) for n in names], "neo_reference_id string")
    got = merge.upsert_stats(refs(stored_refs), refs(listed), to_events(stored), to_events(seen)).first()
    new = len(set(listed) - set(stored_refs))
    added = len(set(seen) - set(stored))
    assert tuple(got) == (new, len(set(listed)) - new, added, len(seen) - added)


def test_stats_of_nothing(spark):
    none = asteroids(spark, [])
    got = merge.upsert_stats(none, none, approaches(spark, []), approaches(spark, [])).first()
    assert tuple(got) == (0, 0, 0, 0)


def test_orphans_and_cascade(spark):
    a = spark.createDataFrame([("1",), ("2",)], "id string")
    p = spark.createDataFrame([("p1", "1"), ("p2", "2"), ("p3", "9")], "id string, asteroid_id string")
    al = spark.createDataFrame([("x", "p1"), ("y", "p2"), ("z", "p8")], "id string, approach_id string")
    assert [r["id"] for r in merge.orphans(p, a, "asteroid_id", "id").collect()] == ["p3"]
    assert [r["id"] for r in merge.orphans(al, p, "approach_id", "id").collect()] == ["z"]
    kept = merge.cascade_delete(a.filter("id = '2'"), a, p, al)
    assert [sorted(r["id"] for r in frame.collect()) for frame in kept] == [
        ["1"], ["p1", "p3"], ["x", "z"]]


def events(spark, rows):
    return spark.createDataFrame(rows, ledger.EVENTS_DDL)


def hour(n):
    return T0 + dt.timedelta(hours=n)


LOG = [
    ("done", "start", hour(0), 0, None, None, None),
    ("done", "complete", hour(1), 1, 5, 7, None),
    ("bad", "start", hour(0), 0, None, None, None),
    ("bad", "fail", hour(1), 1, None, None, "boom"),
    ("open", "start", hour(0), 0, None, None, None),
    ("again", "start", hour(0), 0, None, None, None),
    ("again", "fail", hour(1), 1, None, None, "boom"),
    ("again", "start", hour(2), 2, None, None, None),
    ("redone", "start", hour(0), 0, None, None, None),
    ("redone", "complete", hour(1), 1, 5, 7, None),
    ("redone", "start", hour(2), 2, None, None, None),
    ("redone", "complete", hour(3), 3, 6, 0, None),
]
STATES = {
    "done": (hour(0), hour(1), "completed", 5, 7, None),
    "bad": (hour(0), hour(1), "failed", 0, 0, "boom"),
    "open": (hour(0), None, "running", 0, 0, None),
    "again": (hour(2), hour(1), "running", 0, 0, None),
    "redone": (hour(2), hour(3), "completed", 6, 0, None),
}


def states(df):
    return {r["source_file"]: tuple(r)[2:] for r in df.select(*schemas.ETL_EVENTS.names).collect()}


def test_fold(spark):
    assert states(ledger.fold_events(events(spark, LOG))) == STATES


def test_folding_in_steps_is_folding_at_once(spark):
    current = spark.createDataFrame([], schemas.ETL_EVENTS)
    for step in ([0, 2, 4, 5, 8], [1, 3, 6, 9], [7, 10], [11]):
        part = events(spark, [LOG[i] for i in step])
        current = ledger.apply_events(current, ledger.fold_events(part))
    assert states(current) == STATES


def test_only_completed_files_are_done(spark):
    book = ledger.fold_events(events(spark, LOG))
    files = spark.createDataFrame([(n,) for n in (*STATES, "new")], "source_file string")
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(ledger.completed_files(files, book)) == ["done", "redone"]
    assert names(ledger.pending_files(files, book)) == ["again", "bad", "new", "open"]
    assert ledger.pending_files(files, book, force=True).count() == 6


def test_a_key_with_a_third_of_the_rows(spark):
    """The hot key is reduced in every task before the shuffle, and nothing is lost."""
    hot = spark.range(60000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS asteroid_id",
        "CAST(1 AS bigint) AS epoch_date_close_approach", "'Low' AS hazard_classification",
        "CAST(60000 - id AS int) AS n")
    existing = approaches(spark, [("k1", 1, "High", 0)])
    picked = keep_first(hot, merge.APPROACH_KEY, ["n"])
    assert "partial_min" in picked._jdf.queryExecution().executedPlan().toString()
    merged = merge.upsert_approaches(existing, hot, ["n"])
    assert merged.count() == 40001
    assert merged.filter("asteroid_id = 'hot'").first()["n"] == 60000 - 59997
    assert merged.filter("asteroid_id = 'k1'").first()["hazard_classification"] == "High"
