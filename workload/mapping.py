"""Domain tables expressed over the driver's tables.

Objects come from `part`, close approaches from `lineitem`, load runs from `orders`, request
and query logs from `events`. The SQL side of the same mapping is in `oracles.py`.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from perigee.functions.hazard import classify_hazard
from perigee.functions.ids import alert_id, asteroid_id, ledger_id, with_identifiers
from perigee.functions.numbers import is_finite
from perigee.functions.once import evaluate_once
from perigee.operators.shape import keep_first
from perigee.session import prepare
from perigee.sources.feed import average_diameter

AS_OF = dt.datetime(2001, 10, 1, 12, 0, 0)
METRICS_AS_OF = dt.datetime(2024, 1, 2, 4, 3, 0)
KM_PER_AU = 149597870.7
LD_PER_AU = 389.17
BASE_TIME = "2024-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _base_time() -> Column:
    return F.lit(BASE_TIME).cast("timestamp")


def reference(partkey: str) -> Column:
    return F.col(partkey).cast("string")


def _diameter(divisor: float, size: Column | None = None) -> Column:
    size = F.col("p_size") if size is None else size
    return size.cast("double") / F.lit(divisor)


def asteroids_from(part: DataFrame) -> DataFrame:
    ref = reference("p_partkey")
    rows = with_identifiers(part, ref).select(
        F.col("asteroid_id").alias("id"),
        ref.alias("neo_reference_id"),
        F.concat("p_name", F.lit(" "), ref).alias("name"),
        (F.col("p_retailprice") / F.lit(50.0)).alias("absolute_magnitude"),
        _diameter(160.0).alias("estimated_diameter_min_km"),
        _diameter(80.0).alias("estimated_diameter_max_km"),
        (F.col("p_partkey") % 5 == 0).alias("is_potentially_hazardous"),
        (F.col("p_partkey") % 17 == 0).alias("is_sentry_object"),
        F.concat(F.lit("sbdb/"), ref).alias("nasa_jpl_url"),
        _base_time().alias("created_at"),
        _base_time().alias("updated_at"),
    )
    return rows.select("*", average_diameter())


def asteroids(spark: SparkSession, folder: str) -> DataFrame:
    return asteroids_from(table(spark, folder, "part"))


def sightings(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as close approaches, duplicates included."""
    items = table(spark, folder, "lineitem")
    shipped = F.col("l_shipdate").cast("timestamp")
    return items.select(
        "l_partkey",
        F.unix_millis(shipped).alias("epoch_ms"),
        F.col("l_shipdate").cast("date").alias("close_date"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_quantity",
        "l_discount",
        "l_tax",
    )


SIGHTING_KEY = ["l_partkey", "epoch_ms", "close_date"]
SIGHTING_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]


def _with_ids(rows: DataFrame) -> DataFrame:
    return with_identifiers(rows, reference("l_partkey"), F.col("epoch_ms"))


def _miss_au() -> Column:
    return F.col("l_discount") + F.col("l_tax")


def approach_columns(
    hazard: Column | None = None, ids: bool = True, miss_au: Column | None = None
) -> list[Column]:
    miss_au = _miss_au() if miss_au is None else miss_au
    columns = [
        F.col("close_date").alias("close_approach_date"),
        F.col("epoch_ms").alias("epoch_date_close_approach"),
        (F.col("l_quantity") * F.lit(0.5)).alias("velocity_km_per_s"),
        (F.col("l_quantity") * F.lit(1800.0)).alias("velocity_km_per_h"),
        (miss_au * F.lit(KM_PER_AU)).alias("miss_distance_km"),
        miss_au.alias("miss_distance_astronomical"),
        (miss_au * F.lit(LD_PER_AU)).alias("miss_distance_lunar"),
        F.lit("Earth").alias("orbiting_body"),
        F.timestamp_seconds(F.unix_timestamp(_base_time()) + F.col("l_orderkey")).alias(
            "created_at"
        ),
    ]
    if hazard is not None:
        columns.append(hazard.alias("hazard_classification"))
    return (["id", "asteroid_id"] if ids else []) + columns


def incoming_sightings(rows: DataFrame) -> DataFrame:
    """Sightings as rows to merge: the key of an approach, the columns that order them and what
    `whole_approaches` makes the others from. The distance comes first of those that break ties."""
    return with_identifiers(rows, reference("l_partkey")).select(
        "asteroid_id",
        F.col("epoch_ms").alias("epoch_date_close_approach"),
        *SIGHTING_ORDER,
        _miss_au().alias("miss_au"),
        "close_date",
        "l_partkey",
    )


def whole_approaches(rows: DataFrame, part: DataFrame) -> DataFrame:
    """Approach rows of incoming sightings; one whose part is not there yields none, and of copies
    of a part the first class by name counts."""
    sizes = part.groupBy("p_partkey").agg(F.collect_set(F.struct("p_size")).alias("sizes"))
    known = with_part(
        rows.drop("asteroid_id").withColumnRenamed("epoch_date_close_approach", "epoch_ms"), sizes
    )
    miss_au = F.col("miss_au")
    classes = F.transform("sizes", lambda copy: hazard_of_sighting(copy["p_size"], miss_au))
    return _with_ids(known).select(*approach_columns(F.array_min(classes), miss_au=miss_au))


def hazard_of_sighting(size: Column | None = None, miss_au: Column | None = None) -> Column:
    return classify_hazard(
        _diameter(80.0, size),
        F.col("l_quantity") * F.lit(0.5),
        _miss_au() if miss_au is None else miss_au,
        F.col("p_partkey") % 5 == 0,
    )


def with_part(rows: DataFrame, part: DataFrame) -> DataFrame:
    return rows.join(part, rows["l_partkey"] == part["p_partkey"])


def approaches(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """The approaches table: one row per object and instant, the earliest line wins."""
    first = keep_first(sightings(spark, folder), SIGHTING_KEY, SIGHTING_ORDER)
    part = table(spark, folder, "part").select("p_partkey", "p_size")
    rows = with_part(first, part)
    rows = _with_ids(rows) if ids else rows
    return rows.select(*approach_columns(hazard_of_sighting(), ids))


def plain_approaches(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """The same table without the hazard class, which is what needs the size of the object,
    or also without identifiers, for queries that do not use them."""
    first = keep_first(sightings(spark, folder), SIGHTING_KEY, SIGHTING_ORDER)
    return (_with_ids(first) if ids else first).select(*approach_columns(None, ids))


def etl_events(spark: SparkSession, folder: str) -> DataFrame:
    """One load run per order."""
    orders = table(spark, folder, "orders")
    status = F.col("o_orderstatus")
    started = F.col("o_orderdate").cast("timestamp")
    file = source_file_of(F.col("o_orderkey"))
    return orders.select(
        ledger_id(file).alias("id"),
        file.alias("source_file"),
        started.alias("started_at"),
        F.when(status != "O", started + F.expr("INTERVAL 1 HOUR")).alias("completed_at"),
        F.when(status == "O", "running").when(status == "F", "completed").otherwise("failed").alias("status"),
        F.floor(F.col("o_totalprice") / F.lit(1000.0)).cast("int").alias("asteroids_processed"),
        F.floor(F.col("o_totalprice") / F.lit(100.0)).cast("int").alias("approaches_processed"),
        F.when(status == "P", F.lit("No valid records found in file")).alias("error_message"),
    )


def source_file_of(orderkey: Column) -> Column:
    return F.concat(F.lit("asteroids_"), orderkey.cast("string"), F.lit("_transformed.json"))


def ledger_log(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger events of each order: a start, an end unless open, and for every third order a
    second start a day later, which for even keys ends as well."""
    orders = table(spark, folder, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    begun = F.col("o_orderdate").cast("timestamp")
    small = F.floor(F.col("o_totalprice") / F.lit(1000.0)).cast("int")
    again = key % 3 == 0

    def event(kind: Column, at: Column, sequence: int, there: Column) -> Column:
        complete = kind == "complete"
        return F.when(
            there,
            F.struct(
                kind.alias("kind"),
                at.alias("at"),
                F.lit(sequence).alias("sequence"),
                F.when(complete, small + F.lit(sequence)).alias("asteroids"),
                F.when(complete, small * F.lit(2) + F.lit(sequence)).alias("approaches"),
                F.when(kind == "fail", F.concat(F.lit("error "), key.cast("string"))).alias("message"),
            ),
        )

    first_end = F.when(status == "F", F.lit("complete")).otherwise(F.lit("fail"))
    second_end = F.when(status == "F", F.lit("fail")).otherwise(F.lit("complete"))
    hours = lambda n: begun + F.expr(f"INTERVAL {n} HOURS")
    log = F.array_compact(
        F.array(
            event(F.lit("start"), begun, 0, F.lit(True)),
            event(first_end, hours(1), 1, status != "O"),
            event(F.lit("start"), hours(24), 2, again),
            event(second_end, hours(25), 3, again & (key % 2 == 0)),
        )
    )
    return orders.select(source_file_of(key).alias("source_file"), F.inline(log))


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts for approaches whose winning line has an order key divisible by 3."""
    first = keep_first(sightings(spark, folder), SIGHTING_KEY, SIGHTING_ORDER)
    sent = first.filter(F.col("l_orderkey") % 3 == 0)
    sent = _with_ids(sent).withColumnRenamed("id", "approach_id")
    approach = F.col("approach_id")
    channel = F.when(F.col("l_orderkey") % 2 == 0, "discord").otherwise("email")
    return sent.select(
        alert_id(approach, channel).alias("id"),
        approach,
        channel.alias("alert_type"),
        F.timestamp_seconds(F.unix_timestamp(_base_time()) + F.col("l_orderkey")).alias("alerted_at"),
        F.lit('{"status":"sent"}').alias("payload"),
    )


def http_requests(spark: SparkSession, folder: str) -> DataFrame:
    return requests_of(table(spark, folder, "events"))


def requests_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("user_id") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/"), kind).alias("path"),
        F.when(kind == "error", 500).when(kind == "signup", 404).otherwise(200).alias("status"),
        (F.col("value") / F.lit(1000.0)).alias("duration_s"),
    )


def db_queries(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("operation"),
        F.when(kind == "error", "error").otherwise("success").alias("status"),
        (F.col("value") / F.lit(1000.0)).alias("duration_s"),
    )


def week_start(date: Column) -> Column:
    """First day of the 7-day batch a date falls in."""
    return F.date_sub(date, F.date_diff(date, F.lit(dt.date(1995, 1, 1))) % F.lit(7))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly: a document is some forty times as large as its row and far
    dearer to make and parse than to move. Nothing may shuffle them after this, as adaptive
    execution would put the small rows of many documents into few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _json_text(value: Column) -> Column:
    """Text as a JSON string, escaped as `to_json` does."""
    held = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substr(held, F.lit(6), F.length(held) - F.lit(6)))


def _json_number(value: Column) -> Column:
    text = value.cast("string")
    return F.when(is_finite(value), text).otherwise(_quoted(text))


def _json_object(**fields: Column) -> Column:
    """An object of fields that are JSON already; NULL ones are left out, as by `to_json`, which
    would take the values of a whole document apart and print equal ones again and again."""
    given = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *given), F.lit("}"))


def _parts(**fields: Column | str | list) -> list[Column | str]:
    """The parts of the same object if no field is NULL. Those of objects within are put in line, so
    that all text is copied once, not again at every level."""
    parts: list[Column | str] = []
    for number, (name, value) in enumerate(fields.items()):
        parts += [f'{"," if number else "{"}"{name}":', *(value if isinstance(value, list) else [value])]
    return [*parts, "}"]


def _joined(parts: list[Column | str]) -> Column:
    """The text of parts, NULL if one is."""
    merged: list[Column | str] = []
    for part in parts:
        if isinstance(part, str) and merged and isinstance(merged[-1], str):
            merged[-1] += part
        else:
            merged.append(part)
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in merged])


def _common_year(date: Column) -> Column:
    return F.year(date).between(1000, 9999)


def _digits(date: Column, text: Column) -> Column:
    """`yyyyMMdd` of a date, cut from its text where that has four digits of a year."""
    return F.when(_common_year(date), F.replace(text, F.lit("-"), F.lit(""))).otherwise(F.date_format(date, "yyyyMMdd"))


def _full(date: Column, text: Column) -> Column:
    """`yyyy-MMM-dd HH:mm` of a date, in the same way."""
    names = "JanFebMarAprMayJunJulAugSepOctNovDec"
    name = F.substr(F.lit(names), F.month(date) * 3 - 2, F.lit(3))
    cut = F.concat(F.substring(text, 1, 5), name, F.substring(text, 8, 3), F.lit(" 00:00"))
    return F.when(_common_year(date), cut).otherwise(F.date_format(date, "yyyy-MMM-dd HH:mm"))


def feed_documents(spark: SparkSession, folder: str, lean: bool = False) -> DataFrame:
    """One feed document per line item, in the file of its week. A lean one lists nothing but the
    object of the line item with its first approach.

    A document lists the object of the line item under its ship date, with two approaches,
    and under the next day a second object without any. Its size does not depend on the
    data, so no day or object can grow one document without bound. Every other document
    carries its velocities as JSON numbers instead of text.
    """
    rows = _spread(
        with_part(
            sightings(spark, folder),
            table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"),
        )
    )
    ref = reference("l_partkey")
    miss_au = F.col("l_discount") + F.col("l_tax")
    text = lambda value: value.cast("string")
    # Every step is a generator of its own: in one expression the code made for a whole document
    # is longer than what the JVM compiles.
    mark = F.when(F.col("l_orderkey") % 2 == 0, F.lit("")).otherwise(F.lit('"'))
    speed = lambda factor: F.concat(mark, text(F.col("l_quantity") * F.lit(factor)), mark)
    days = range(1 if lean else 2)
    date = lambda day: F.date_add("close_date", day)
    rows = evaluate_once(
        rows,
        ref=ref,
        supplier=text(F.col("l_suppkey")),
        low=_json_number(_diameter(160.0)),
        high=_json_number(_diameter(80.0)),
        magnitude=_json_number(F.col("p_retailprice") / F.lit(50.0)),
        sentry=text(F.col("p_partkey") % 17 == 0),
        title=_json_text(F.concat("p_name", F.lit(" "), ref)),
    )
    rows = evaluate_once(
        rows,
        per_second=speed(0.5), per_hour=speed(1800.0), miles_per_hour=speed(1118.0),
        au=_quoted(text(miss_au)),
        lunar=_quoted(text(miss_au * F.lit(LD_PER_AU))),
        km=_quoted(text(miss_au * F.lit(KM_PER_AU))),
        miles=_quoted(text(miss_au * F.lit(92955807.0))),
    )
    begin = week_start(F.col("close_date"))
    rows = evaluate_once(
        rows, day0=text(date(0)), day1=text(date(1)), first_day=text(begin), last_day=text(F.date_add(begin, 6))
    )
    rows = evaluate_once(rows, **{f"full{day}": _full(date(day), F.col(f"day{day}")) for day in days})
    ref, supplier = F.col("ref"), F.col("supplier")
    velocity = dict(kilometers_per_second=F.col("per_second"), kilometers_per_hour=F.col("per_hour"), miles_per_hour=F.col("miles_per_hour"))
    distance = dict(astronomical=F.col("au"), lunar=F.col("lunar"), kilometers=F.col("km"), miles=F.col("miles"))
    units = ("kilometers", "meters", "miles", "feet")
    quiet = '{"estimated_diameter_min":0.25,"estimated_diameter_max":0.5}'

    # a document of which nothing is NULL is joined in one go
    quote = lambda *values: ['"', *values, '"']
    rows = evaluate_once(
        rows,
        span=_joined(_parts(estimated_diameter_min=F.col("low"), estimated_diameter_max=F.col("high"))),
        measured=_joined(["relative_velocity\":", *_parts(**velocity), ',"miss_distance":', *_parts(**distance), ',"orbiting_body":"Earth"}']),
    )

    def approach_parts(day: int) -> list[Column | str]:
        held = _parts(
            close_approach_date=quote(F.col(f"day{day}")),
            close_approach_date_full=quote(F.col(f"full{day}")),
            epoch_date_close_approach=text(F.col("epoch_ms") + F.lit(day * 86400000)),
        )
        return [*held[:-1], ',"', F.col("measured")]

    def neo_parts(key: list, name: Column | list, diameter: Column | str, pha: Column | str, items: list) -> list[Column | str]:
        return _parts(
            links=_parts(self=quote("neo/", *key)),
            id=quote(*key),
            neo_reference_id=quote(*key),
            name=name,
            nasa_jpl_url=quote("sbdb/", *key),
            absolute_magnitude_h=F.col("magnitude"),
            estimated_diameter=_parts(**{unit: diameter for unit in units}),
            is_potentially_hazardous_asteroid=pha,
            close_approach_data=["[", *items, "]"],
            is_sentry_object=F.col("sentry"),
        )

    items = approach_parts(0) if lean else [*approach_parts(0), ",", *approach_parts(1)]
    rows = evaluate_once(
        rows, listed=_joined(neo_parts([ref], F.col("title"), F.col("span"), text(F.col("p_partkey") % 5 == 0), items))
    )
    near = ['{"', F.col("day0"), '":[', F.col("listed"), "]"]
    if not lean:
        rows = evaluate_once(
            rows, unlisted=_joined(neo_parts(["S", supplier], quote("quiet ", supplier), quiet, "false", []))
        )
        near += [',"', F.col("day1"), '":[', F.col("unlisted"), "]"]
    document = _parts(
        links=_parts(self=quote("feed/", ref)), element_count="1" if lean else "2", near_earth_objects=[*near, "}"]
    )
    rows = evaluate_once(rows, whole=_joined(document))

    # of one that has a NULL what is there is put together level by level
    rest = lambda value: F.when(F.col("whole").isNull(), value)
    dated = F.coalesce(F.col("day0"), F.raise_error(F.lit("a line item has no ship date")).cast("string"))
    rows = evaluate_once(
        rows,
        range=rest(_json_object(estimated_diameter_min=F.col("low"), estimated_diameter_max=F.col("high"))),
        velocity=rest(_json_object(**velocity)),
        distance=rest(_json_object(**distance)),
    )

    def approach(day: int) -> Column:
        return _json_object(
            close_approach_date=_quoted(F.col(f"day{day}")),
            close_approach_date_full=_quoted(F.col(f"full{day}")),
            epoch_date_close_approach=text(F.col("epoch_ms") + F.lit(day * 86400000)),
            relative_velocity=F.col("velocity"),
            miss_distance=F.col("distance"),
            orbiting_body=F.lit('"Earth"'),
        )

    def neo(key: Column, name: Column, diameter: Column, pha: Column, items: list[str]) -> Column:
        return _json_object(
            links=_json_object(self=_quoted(F.concat(F.lit("neo/"), key))),
            id=_quoted(key),
            neo_reference_id=_quoted(key),
            name=name,
            nasa_jpl_url=_quoted(F.concat(F.lit("sbdb/"), key)),
            absolute_magnitude_h=F.col("magnitude"),
            estimated_diameter=diameter,
            is_potentially_hazardous_asteroid=text(pha),
            close_approach_data=F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]")),
            is_sentry_object=F.col("sentry"),
        )

    wide = lambda size: _json_object(**{unit: size for unit in units})
    rows = evaluate_once(rows, first=rest(approach(0)), wide=rest(wide(F.col("range"))))
    items = ["first"]
    if not lean:
        rows = evaluate_once(rows, second=rest(approach(1)))
        items.append("second")
    rows = evaluate_once(rows, seen=rest(neo(ref, F.col("title"), F.col("wide"), F.col("p_partkey") % 5 == 0, items)))
    if not lean:
        unseen = neo(
            F.concat(F.lit("S"), supplier), _quoted(F.concat(F.lit("quiet "), supplier)), wide(F.lit(quiet)), F.lit(False), []
        )
        rows = evaluate_once(rows, unseen=rest(unseen))
    listed = lambda day, item: F.concat(_quoted(day), F.lit(":["), item, F.lit("]"))
    near = [listed(dated, F.col("seen"))]
    if not lean:
        near.append(listed(F.col("day1"), F.col("unseen")))
    loose = _json_object(
        links=_json_object(self=_quoted(F.concat(F.lit("feed/"), ref))),
        element_count=F.lit("1" if lean else "2"),
        near_earth_objects=F.concat(F.lit("{"), F.concat_ws(",", *near), F.lit("}")),
    )
    name = F.concat(
        F.lit("asteroids_"),
        _digits(begin, F.col("first_day")),
        F.lit("_"),
        _digits(F.date_add(begin, 6), F.col("last_day")),
        F.lit(".json"),
    )
    return rows.select(name.alias("source_file"), F.coalesce("whole", loose).alias("document"))
