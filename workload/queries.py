"""The registered queries: each runs one operator over whole driver tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from perigee.functions import display
from perigee.functions.hazard import has_status, normalise_hazard, normalise_status, severity_rank
from perigee.functions.numbers import lenient_double
from perigee.functions.once import evaluate_once
from perigee.operators import alerts as alerting
from perigee.operators import ledger, merge, reads, telemetry
from perigee.operators.reads import ApproachFilter, Period
from perigee.plans import extract, load, transform
from perigee.sources import batches, feed, records

from . import chains, mapping as m

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# what the parameterised queries ask for; `oracles.py` states the same in SQL
PAGE_RANGE = ApproachFilter(dt.date(1997, 1, 1), dt.date(1997, 3, 31), page=2)
PAGE_HAZARD = ApproachFilter(hazard_class="Critical", page=3)
PAGE_ALL = ApproachFilter(
    dt.date(1996, 1, 1), dt.date(1999, 12, 31), "High", "velocity", "asc", page=2, page_size=25
)
PAGE_TOTAL = ApproachFilter(dt.date(1996, 1, 1), dt.date(1999, 12, 31), "High")
VELOCITY_FROM, VELOCITY_TO = dt.date(1998, 2, 1), dt.date(1998, 2, 14)
FEED_FROM, FEED_TO = dt.date(1998, 1, 1), dt.date(1998, 6, 30)
LOADED_BEFORE = dt.date(1996, 1, 1)
STORED_BEFORE = dt.date(1997, 1, 1)


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _dates_as_text(function(spark, folder))

        REGISTRY[name] = run
        return function

    return register


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(field.name).cast("string").alias(field.name)
            if isinstance(field.dataType, T.DateType)
            else F.col(field.name)
            for field in df.schema.fields
        ]
    )


# --- feed and records ------------------------------------------------------------------


def _feeds(spark: SparkSession, folder: str) -> DataFrame:
    return feed.valid_feeds(feed.decode_feed(m.feed_documents(spark, folder)))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return transform.transform_feed(m.feed_documents(spark, folder), m.AS_OF)


@query("feed_flatten_asteroids")
def _(spark, folder):
    rows = feed.asteroid_rows(feed.feed_objects(_feeds(spark, folder)), F.lit(None).cast("timestamp"))
    return rows.drop("created_at", "updated_at", "position")


@query("feed_flatten_approaches")
def _(spark, folder):
    rows = feed.approach_rows(feed.feed_objects(_feeds(spark, folder)), F.lit(None).cast("timestamp"))
    return rows.drop("created_at", "position")


@query("object_counts")
def _(spark, folder):
    """The documents of some weeks declare a count that is not theirs."""
    documents = m.feed_documents(spark, folder)
    wrong = F.col("source_file").contains("03")
    document = F.when(wrong, F.replace("document", F.lit('"element_count":2'), F.lit('"element_count":3'))).otherwise(F.col("document"))
    decoded = feed.decode_feed(documents.withColumn("document", document))
    return feed.object_counts(feed.valid_feeds(decoded))


@query("record_round_trip")
def _(spark, folder):
    """Every approach, written to its record line and read back."""
    lines = records.encode_records(_records(spark, folder))
    rows = records.record_approaches(records.decode_records(lines))
    return rows.drop("created_at")


@query("feed_date_range")
def _(spark, folder):
    objects = feed.feed_objects(_feeds(spark, folder), FEED_FROM, FEED_TO)
    return objects.select("source_file", "feed_date", "neo.neo_reference_id")


@query("lenient_double")
def _(spark, folder):
    items = m.table(spark, folder, "lineitem")
    number = F.col("l_quantity").cast("string")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    text = (
        F.when(kind == 0, F.concat(F.lit('"'), number, F.lit('"')))
        .when(kind == 1, number)
        .when(kind == 2, F.concat(F.lit('" '), number, F.lit(' "')))
        .when(kind == 3, F.concat(F.lit('"'), number, F.lit('d"')))
        .when(kind == 4, F.lit('"not-a-number"'))
        .when(kind == 5, F.lit("[1, 2]"))
        .when(kind == 6, F.concat(F.lit('"-'), number, F.lit('e2"')))
        .otherwise(F.lit('"NaN"'))
    )
    document = F.concat(F.lit('{"value": '), text, F.lit("}"))
    value = F.from_json(document, "value string", feed.JSON_OPTIONS)["value"]
    parsed = items.select(
        "l_orderkey", "l_linenumber", "l_partkey", lenient_double(value).alias("number")
    )
    return parsed.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("number").isNotNull().alias("accepted"),
        F.coalesce(F.isnan("number"), F.lit(False)).alias("is_nan"),
        F.when(~F.isnan("number"), F.col("number")).alias("number"),
    )


@query("ndjson_record_audit")
def _(spark, folder):
    """Lines with every kind of damage: sentry objects are cut off, some are blank."""
    encoded = records.encode_records(_records(spark, folder))
    lines = evaluate_once(encoded.withColumnRenamed("value", "line"), value=F.col("line"))
    name = F.regexp_extract("value", r'"neo_reference_id":"([^"]*)"', 1)
    sentry = F.col("value").contains('"is_sentry_object":true')
    hazardous = F.col("value").contains('"is_potentially_hazardous":true')
    damaged = (
        F.when(sentry & name.startswith("S"), F.lit("  \t "))
        .when(sentry, F.expr("substring(value, 1, length(value) - 5)"))
        .when(hazardous, F.concat(F.lit("  "), F.col("value"), F.lit("  ")))
        .otherwise(F.col("value"))
    )
    return records.record_audit(
        records.decode_records(lines.select("source_file", damaged.alias("value")))
    )


def _weeks(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly batches over the span of all ship dates."""
    dates = m.sightings(spark, folder).agg(
        F.min("close_date").alias("low"), F.max("close_date").alias("high")
    )
    span = dates.select(
        m.week_start(F.col("low")).alias("range_start"),
        F.date_add(m.week_start(F.col("high")), 6).alias("range_end"),
    )
    return batches.date_batches(span, "range_start", "range_end")


def _landed_weeks(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the weeks whose first day lies in an even month."""
    begin = m.week_start(F.col("close_date"))
    rows = m.sightings(spark, folder).filter(F.month(begin) % 2 == 0)
    return rows.select(batches.batch_file(begin, F.date_add(begin, 6)).alias("batch_file")).distinct()


@query("pending_batches")
def _(spark, folder):
    pending = extract.pending_batches(_weeks(spark, folder), _landed_weeks(spark, folder))
    return pending.select("batch_number", "batch_start", "batch_end", "batch_file")


@query("extraction_metadata")
def _(spark, folder):
    planned, landed = _weeks(spark, folder), _landed_weeks(spark, folder)
    # the answers of one month broke off
    cut = F.col("source_file").startswith("asteroids_199803")
    document = F.when(cut, F.substring("document", 1, 40)).otherwise(F.col("document"))
    documents = m.feed_documents(spark, folder).withColumn("document", document)
    results = extract.batch_results(planned, landed, documents)
    return extract.describe(extract.extraction_summary(results), m.AS_OF)


@query("date_batches")
def _(spark, folder):
    date = F.col("o_orderdate").cast("date")
    ranges = m.table(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )
    return batches.date_batches(ranges, "first_date", "last_date").drop("first_date", "last_date")


@query("transform_summary")
def _(spark, folder):
    begin = m.week_start(F.col("close_date"))
    files = m.sightings(spark, folder).select(
        batches.batch_file(begin, F.date_add(begin, 6)).alias("source_file"), begin.alias("begin")
    ).distinct()
    done = files.filter(F.col("begin") < F.lit(LOADED_BEFORE)).select("source_file")
    return transform.transform_summary(m.feed_documents(spark, folder), files.select("source_file"), done)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    approaches = m.plain_approaches(spark, folder)
    return approaches.filter(F.col("close_approach_date") < F.lit(STORED_BEFORE))


@query("load_summary")
def _(spark, folder):
    begin = m.week_start(F.col("close_date"))
    every = m.sightings(spark, folder).select(
        batches.batch_file(begin, F.date_add(begin, 6)).alias("source_file"), begin.alias("begin")
    ).distinct()
    old = F.col("begin") < F.lit(LOADED_BEFORE)
    done = every.filter(old).select("source_file")
    files = every.filter(~old).select("source_file")
    documents = batches.pending(m.feed_documents(spark, folder), done, "source_file")
    keys = feed.merge_keys(feed.feed_objects(feed.valid_feeds(feed.decode_feed(documents))))
    return load.load_summary(load.counted_load(files, keys, _stored(spark, folder)), done)


@query("upsert_stats")
def _(spark, folder):
    keys = feed.merge_keys(feed.feed_objects(_feeds(spark, folder)))
    known = m.asteroids(spark, folder).filter("is_sentry_object")
    return merge.merge_counts(keys, known, _stored(spark, folder))


# --- expressions over the tables -------------------------------------------------------


@query("hazard_classify")
def _(spark, folder):
    return m.approaches(spark, folder).select("id", "hazard_classification")


@query("asteroid_uuid5")
def _(spark, folder):
    return m.asteroids(spark, folder).select("id", "neo_reference_id")


@query("approach_uuid5")
def _(spark, folder):
    return m.plain_approaches(spark, folder).select(
        "id", "asteroid_id", "epoch_date_close_approach"
    )


@query("diameter_avg")
def _(spark, folder):
    return m.asteroids(spark, folder).select("id", "estimated_diameter_avg_km")


@query("enum_normalise")
def _(spark, folder):
    orders = m.table(spark, folder, "orders")
    status = (
        F.when(F.col("o_orderstatus") == "F", "Completed")
        .when(F.col("o_orderstatus") == "P", "FAILED")
        .otherwise(F.col("o_orderpriority"))
    )
    hazard = (
        F.when(F.col("o_orderpriority").startswith("1"), "Critical")
        .when(F.col("o_orderpriority").startswith("2"), "High")
        .when(F.col("o_orderpriority").startswith("3"), "medium")
        .when(F.col("o_orderpriority").startswith("4"), "Medium")
        .otherwise(F.col("o_orderpriority"))
    )
    return orders.select(
        "o_orderkey",
        normalise_status(status).alias("status"),
        has_status(status, "running").alias("is_running"),
        has_status(status, "completed").alias("is_completed"),
        has_status(status, "failed").alias("is_failed"),
        normalise_hazard(hazard).alias("hazard"),
        severity_rank(normalise_hazard(hazard)).alias("severity"),
    )


@query("fmt_number")
def _(spark, folder):
    price = F.col("o_totalprice")
    return m.table(spark, folder, "orders").select(
        "o_orderkey",
        display.format_number(price * F.lit(10.0)).alias("large"),
        display.format_number(price).alias("medium"),
        display.format_number(price / F.lit(1000.0)).alias("small"),
    )


def _view(spark: SparkSession, folder: str) -> DataFrame:
    joined = reads.with_asteroids(m.approaches(spark, folder), m.asteroids(spark, folder))
    return joined


@query("fmt_alert_fields")
def _(spark, folder):
    return alerting.alert_fields(_view(spark, folder).withColumnRenamed("id", "approach_id"))


@query("approach_display_row")
def _(spark, folder):
    return reads.display_rows(_view(spark, folder))


# --- reads -----------------------------------------------------------------------------


@query("recent_approaches")
def _(spark, folder):
    return reads.recent_approaches(m.approaches(spark, folder), m.asteroids(spark, folder), True)


@query("approach_asteroid_join")
def _(spark, folder):
    return _view(spark, folder).select(*reads.APPROACH_VIEW, "neo_reference_id")


@query("asteroid_lookup")
def _(spark, folder):
    wanted = m.sightings(spark, folder).filter("l_quantity = 50").select(
        m.reference("l_partkey").alias("neo_reference_id")
    )
    found = reads.asteroid_lookup(m.asteroids(spark, folder), wanted)
    return found.select("id", "neo_reference_id", "name", "absolute_magnitude", "nasa_jpl_url")


def _page(wanted: ApproachFilter) -> Query:
    def run(spark, folder):
        return reads.approaches_page(m.approaches(spark, folder), m.asteroids(spark, folder), wanted, True)

    return run


query("approaches_page")(_page(ApproachFilter(page=3)))
query("approaches_page_date_range")(_page(PAGE_RANGE))
query("approaches_page_hazard")(_page(PAGE_HAZARD))
query("approaches_page_all_filters")(_page(PAGE_ALL))
query("approaches_sort_velocity")(_page(ApproachFilter(sort_by="velocity")))
query("approaches_sort_distance")(_page(ApproachFilter(sort_by="distance", sort_dir="asc")))
query("approaches_sort_name")(_page(ApproachFilter(sort_by="name", sort_dir="asc", page=2)))
query("approaches_sort_hazard")(_page(ApproachFilter(sort_by="hazard")))
query("approaches_sort_date")(_page(ApproachFilter(sort_by="date", sort_dir="asc")))


@query("approaches_page_deep")
def _(spark, folder):
    """The page in the middle of the whole table."""
    approaches = m.approaches(spark, folder)
    middle = m.plain_approaches(spark, folder, ids=False).count() // 2 // reads.PAGE_SIZE
    wanted = ApproachFilter(page=middle + 1)
    return reads.approaches_page(approaches, m.asteroids(spark, folder), wanted, True)


@query("approaches_page_total")
def _(spark, folder):
    return reads.approaches_total(m.approaches(spark, folder, ids=False), PAGE_TOTAL)


@query("velocity_latest")
def _(spark, folder):
    return reads.velocity_latest(m.plain_approaches(spark, folder), m.asteroids(spark, folder), True)


@query("velocity_date_range")
def _(spark, folder):
    return reads.velocity(
        m.plain_approaches(spark, folder),
        m.asteroids(spark, folder),
        start=VELOCITY_FROM,
        end=VELOCITY_TO,
    )


def _velocity(period: Period) -> Query:
    def run(spark, folder):
        return reads.velocity(
            m.plain_approaches(spark, folder), m.asteroids(spark, folder), period, as_of=m.AS_OF
        )

    return run


for _period in Period:
    query(f"velocity_period_{_period.value}")(_velocity(_period))


@query("daily_avg_velocity")
def _(spark, folder):
    return reads.daily_avg_velocity(m.plain_approaches(spark, folder, ids=False))


def _chart(rows: DataFrame) -> DataFrame:
    return _rounded(reads.velocity_chart(rows), "velocity")


@query("velocity_chart")
def _(spark, folder):
    return _chart(m.plain_approaches(spark, folder, ids=False))


@query("velocity_chart_empty")
def _(spark, folder):
    """No approach is that slow."""
    return _chart(m.plain_approaches(spark, folder, ids=False).filter("velocity_km_per_h < 0"))


@query("count_asteroids")
def _(spark, folder):
    return reads.count_asteroids(m.asteroids(spark, folder))


@query("count_approaches")
def _(spark, folder):
    return reads.count_approaches(m.plain_approaches(spark, folder, ids=False))


@query("count_hazardous")
def _(spark, folder):
    return reads.count_hazardous(m.asteroids(spark, folder))


@query("dashboard_stats")
def _(spark, folder):
    approaches = m.plain_approaches(spark, folder, ids=False)
    return reads.dashboard_stats(m.asteroids(spark, folder), approaches)


@query("hazard_breakdown")
def _(spark, folder):
    return reads.hazard_breakdown(m.approaches(spark, folder, ids=False))


@query("count_etl_runs")
def _(spark, folder):
    return reads.count_runs(m.etl_events(spark, folder))


@query("recent_etl_runs")
def _(spark, folder):
    return reads.recent_runs(m.etl_events(spark, folder))


@query("etl_runs_page")
def _(spark, folder):
    return reads.runs_page(m.etl_events(spark, folder), page=2, page_size=20)


@query("etl_runs_total")
def _(spark, folder):
    return reads.runs_total(m.etl_events(spark, folder))


@query("last_etl_run")
def _(spark, folder):
    return reads.last_run(m.etl_events(spark, folder))


# --- merges and the ledger -------------------------------------------------------------


@query("upsert_asteroids")
def _(spark, folder):
    """Stored: all but economy parts. Incoming: an object per line item."""
    part = m.table(spark, folder, "part")
    existing = m.asteroids_from(part.filter("p_type <> 'ECONOMY'"))
    listed = m.table(spark, folder, "lineitem").join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    revised = F.concat("p_name", F.lit(" rev "), F.col("l_orderkey").cast("string"))
    moment = F.lit(m.AS_OF.isoformat()).cast("timestamp")
    # the place in the listing rides along to order the copies
    order = F.struct("l_shipdate", *m.SIGHTING_ORDER).alias("listing")
    incoming = listed.select("p_partkey", order, revised.alias("revised"), "l_quantity", "p_size")
    ref = m.reference("p_partkey")
    low, high = F.col("p_size") / F.lit(160.0), F.col("p_size") / F.lit(40.0)
    incoming = incoming.select(
        "listing",
        m.asteroid_id(ref).alias("id"),
        ref.alias("neo_reference_id"),
        F.col("revised").alias("name"),
        F.col("l_quantity").alias("absolute_magnitude"),
        low.alias("estimated_diameter_min_km"),
        high.alias("estimated_diameter_max_km"),
        (F.col("l_quantity") > 25).alias("is_potentially_hazardous"),
        F.lit(True).alias("is_sentry_object"),
        F.concat(F.lit("sbdb/"), ref).alias("nasa_jpl_url"),
        moment.alias("created_at"),
        moment.alias("updated_at"),
        F.lit(None).cast("double").alias("estimated_diameter_avg_km"),
    )
    return merge.upsert_asteroids(existing, incoming, ["listing"])


@query("upsert_approaches")
def _(spark, folder):
    """Stored: approaches before 1997, all of them classed Low. Incoming: every line item."""
    existing = _stored(spark, folder).withColumn("hazard_classification", F.lit("Low"))
    part = m.table(spark, folder, "part").select("p_partkey", "p_size")
    merged = merge.upsert_approaches(
        existing,
        m.incoming_sightings(m.sightings(spark, folder)),
        m.SIGHTING_ORDER,
        lambda rows: m.whole_approaches(rows, part),
    )
    return merged.drop("orbiting_body", "velocity_km_per_s")


@query("fk_orphans")
def _(spark, folder):
    """References left dangling if the sentry objects were missing."""
    approaches = m.plain_approaches(spark, folder)
    present = m.asteroids(spark, folder).filter("NOT is_sentry_object")
    dangling = merge.orphans(approaches, present, "asteroid_id", "id")
    kept = approaches.filter(F.col("close_approach_date") >= F.lit(STORED_BEFORE))
    unsent = merge.orphans(m.alerts(spark, folder), kept, "approach_id", "id")
    return dangling.select(F.lit("approaches").alias("child"), "id").unionByName(
        unsent.select(F.lit("alerts").alias("child"), "id")
    )


@query("cascade_delete")
def _(spark, folder):
    asteroids = m.asteroids(spark, folder)
    kept = merge.cascade_delete(
        asteroids.filter("is_sentry_object"),
        asteroids,
        m.plain_approaches(spark, folder),
        m.alerts(spark, folder),
    )
    names = ("asteroids", "approaches", "alerts")
    parts = [frame.select(F.lit(name).alias("kept_in"), "id") for name, frame in zip(names, kept)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("etl_events_latest")
def _(spark, folder):
    return ledger.fold_events(m.ledger_log(spark, folder))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    keys = m.table(spark, folder, "lineitem").select("l_orderkey").distinct()
    return keys.select(m.source_file_of(F.col("l_orderkey")).alias("source_file"))


@query("files_already_processed")
def _(spark, folder):
    return ledger.completed_files(_files(spark, folder), m.etl_events(spark, folder))


@query("pending_files")
def _(spark, folder):
    return ledger.pending_files(_files(spark, folder), m.etl_events(spark, folder))


# --- alerts ----------------------------------------------------------------------------


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return alerting.alert_candidates(
        m.approaches(spark, folder),
        m.asteroids(spark, folder),
        m.alerts(spark, folder),
        m.AS_OF.date(),
    )


@query("alert_candidates")
def _(spark, folder):
    return _candidates(spark, folder)


@query("alerts_anti_join")
def _(spark, folder):
    fresh = alerting.not_alerted(m.plain_approaches(spark, folder), m.alerts(spark, folder))
    return fresh.select("id", "close_approach_date")


@query("alert_payload")
def _(spark, folder):
    return alerting.alert_messages(_candidates(spark, folder))


@query("alert_outbox")
def _(spark, folder):
    return alerting.outbox(_candidates(spark, folder))


@query("record_alerts")
def _(spark, folder):
    """Every urgent approach was delivered, and every critical one twice."""
    approaches = m.approaches(spark, folder)
    urgent = approaches.filter(F.col("hazard_classification").isin("Critical", "High"))
    twice = F.when(F.col("hazard_classification") == "Critical", 2).otherwise(1)
    sent = urgent.select(
        F.col("id").alias("approach_id"),
        F.explode(F.array_repeat(F.lit(alerting.CHANNEL), twice)).alias("alert_type"),
    )
    return alerting.record_alerts(m.alerts(spark, folder), sent, m.AS_OF)


# --- telemetry -------------------------------------------------------------------------


@query("http_requests_total")
def _(spark, folder):
    return telemetry.counter(m.http_requests(spark, folder), telemetry.HTTP_LABELS)


@query("db_queries_total")
def _(spark, folder):
    return telemetry.counter(m.db_queries(spark, folder), telemetry.DB_LABELS)


def _rounded(df: DataFrame, column: str) -> DataFrame:
    # sums of doubles depend on their order in the last places
    return df.withColumn(column, F.round(column, 6))


@query("http_duration_histogram")
def _(spark, folder):
    log = m.http_requests(spark, folder)
    return _rounded(
        telemetry.histogram(log, telemetry.HTTP_LABELS, telemetry.HTTP_BUCKETS), "sum_s"
    )


@query("db_duration_histogram")
def _(spark, folder):
    log = m.db_queries(spark, folder)
    return _rounded(telemetry.histogram(log, telemetry.DB_LABELS, telemetry.DB_BUCKETS), "sum_s")


@query("requests_per_second")
def _(spark, folder):
    rates = telemetry.http_rates(m.http_requests(spark, folder))
    return rates.select("window_start", "requests_per_second")


@query("error_rate_percent")
def _(spark, folder):
    rates = telemetry.http_rates(m.http_requests(spark, folder))
    return rates.select("window_start", "error_rate_percent")


@query("avg_response_time_ms")
def _(spark, folder):
    rates = telemetry.http_rates(m.http_requests(spark, folder))
    return _rounded(rates.select("window_start", "avg_response_time_ms"), "avg_response_time_ms")


@query("db_queries_per_second")
def _(spark, folder):
    return telemetry.db_rates(m.db_queries(spark, folder))


@query("error_rate_class")
def _(spark, folder):
    rates = telemetry.http_rates(m.http_requests(spark, folder))
    share = F.col("error_rate_percent")
    return rates.select(
        "window_start",
        F.concat(display.rate_text(share), F.lit("%")).alias("error_rate"),
        display.error_rate_class(share).alias("error_rate_class"),
    )


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.metrics_summary(
        m.http_requests(spark, folder),
        m.db_queries(spark, folder),
        m.asteroids(spark, folder),
        m.plain_approaches(spark, folder, ids=False),
        m.etl_events(spark, folder),
        m.METRICS_AS_OF,
    )


@query("metrics_summary")
def _(spark, folder):
    return _rounded(_summary(spark, folder), "avg_response_time_ms")


@query("metric_texts")
def _(spark, folder):
    return telemetry.metric_texts(_summary(spark, folder))


# --- chains over files -----------------------------------------------------------------

for _name in ("landing_round_trip", "landed_range", "file_chain", "streamed_load", "streamed_rates"):
    query(_name)(getattr(chains, _name))
