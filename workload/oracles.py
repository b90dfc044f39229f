"""The registered queries in SQL, over the same mapping as `mapping.py`."""

from __future__ import annotations

import re

NS_ASTEROID = "6ba7b8109dad11d180b400c04fd430c8"
NS_APPROACH = "7cb8c921aebe22e291c511d15fe541d9"


def uuid5(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace}') || encode({name}))"
    variant = f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"{variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
    )


def asteroid_id(ref: str) -> str:
    return uuid5(NS_ASTEROID, ref)


def approach_id(ref: str, epoch: str) -> str:
    return uuid5(NS_APPROACH, f"({ref} || ':' || CAST({epoch} AS VARCHAR))")


def alert_id(approach: str, channel: str) -> str:
    return uuid5(NS_APPROACH, f"('alert:' || {channel} || ':' || {approach})")


def hazard(dmax: str, speed: str, au: str, pha: str) -> str:
    return (
        f"CASE WHEN {pha} AND {au} < 0.05::DOUBLE THEN 'Critical' "
        f"WHEN {dmax} > 0.5::DOUBLE OR ({speed} > 20 AND {au} < 0.1::DOUBLE) THEN 'High' "
        f"WHEN {dmax} > 0.1::DOUBLE OR {speed} > 10 THEN 'Medium' ELSE 'Low' END"
    )


def week(date: str) -> str:
    return f"({date} - CAST(date_diff('day', DATE '1995-01-01', {date}) % 7 AS INTEGER))"


def week_file(date: str) -> str:
    first = week(date)
    return (
        f"('asteroids_' || strftime({first}, '%Y%m%d') || '_' || "
        f"strftime({first} + 6, '%Y%m%d') || '.json')"
    )


def batch_name(date: str) -> str:
    """The file of the batch of 91 days that a date falls in."""
    first = f"({date} - CAST(date_diff('day', DATE '1995-01-01', {date}) % 91 AS INTEGER))"
    return f"('asteroids_' || strftime({first}, '%Y%m%d') || '_' || strftime({first} + 90, '%Y%m%d') || '.json')"


AU = "(l_discount + l_tax)"
REF = "CAST(l_partkey AS VARCHAR)"
PART_REF = "CAST(p_partkey AS VARCHAR)"
ORDER_FILE = "('asteroids_' || CAST({} AS VARCHAR) || '_transformed.json')"
DMAX = "(CAST(p_size AS DOUBLE) / 80)"
DMIN = "(CAST(p_size AS DOUBLE) / 160)"

CTES = {
    "asteroids": f"""
        SELECT {asteroid_id(PART_REF)} AS id, {PART_REF} AS neo_reference_id,
               p_name || ' ' || {PART_REF} AS name, p_retailprice / 50 AS absolute_magnitude,
               {DMIN} AS estimated_diameter_min_km, {DMAX} AS estimated_diameter_max_km,
               p_partkey % 5 = 0 AS is_potentially_hazardous,
               p_partkey % 17 = 0 AS is_sentry_object, 'sbdb/' || {PART_REF} AS nasa_jpl_url,
               TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at,
               ({DMIN} + {DMAX}) / 2 AS estimated_diameter_avg_km
        FROM part""",
    "sightings": """
        SELECT *, epoch_ms(l_shipdate) AS epoch, CAST(l_shipdate AS DATE) AS close_date
        FROM lineitem""",
    "firsts": """
        SELECT * FROM sightings
        QUALIFY row_number() OVER (
            PARTITION BY l_partkey, epoch
            ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_discount, l_tax) = 1""",
    "approaches": f"""
        SELECT {approach_id(REF, 'epoch')} AS id, {asteroid_id(REF)} AS asteroid_id,
               close_date AS close_approach_date, epoch AS epoch_date_close_approach,
               l_quantity * 0.5::DOUBLE AS velocity_km_per_s,
               l_quantity * 1800 AS velocity_km_per_h,
               {AU} * 149597870.7::DOUBLE AS miss_distance_km,
               {AU} AS miss_distance_astronomical, {AU} * 389.17::DOUBLE AS miss_distance_lunar,
               'Earth' AS orbiting_body,
               {hazard(DMAX, 'l_quantity * 0.5::DOUBLE', AU, 'p_partkey % 5 = 0')}
                   AS hazard_classification,
               TIMESTAMP '2024-01-01' + to_seconds(l_orderkey) AS created_at
        FROM firsts JOIN part ON l_partkey = p_partkey""",
    "alerts": f"""
        SELECT {alert_id('approach_id', 'alert_type')} AS id, approach_id, alert_type, alerted_at
        FROM (SELECT {approach_id(REF, 'epoch')} AS approach_id,
                     CASE WHEN l_orderkey % 2 = 0 THEN 'discord' ELSE 'email' END AS alert_type,
                     TIMESTAMP '2024-01-01' + to_seconds(l_orderkey) AS alerted_at
              FROM firsts WHERE l_orderkey % 3 = 0)""",
    "etl_events": f"""
        SELECT {uuid5(NS_ASTEROID, "('etl:' || source_file)")} AS id, source_file, started_at,
               completed_at, status, asteroids_processed, approaches_processed, error_message
        FROM (SELECT {ORDER_FILE.format('o_orderkey')} AS source_file, o_orderdate AS started_at,
                     CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END
                         AS completed_at,
                     CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed'
                         ELSE 'failed' END AS status,
                     CAST(floor(o_totalprice / 1000) AS INTEGER) AS asteroids_processed,
                     CAST(floor(o_totalprice / 100) AS INTEGER) AS approaches_processed,
                     CASE WHEN o_orderstatus = 'P' THEN 'No valid records found in file' END
                         AS error_message
              FROM orders)""",
    "http_requests": """
        SELECT ts, CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
               '/' || event_type AS path,
               CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status,
               value / 1000 AS duration_s
        FROM events""",
    "db_queries": """
        SELECT ts, event_type AS operation,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
               value / 1000 AS duration_s
        FROM events""",
    # objects and approaches as the feed documents list them
    "listed": f"""
        SELECT {week_file('close_date')} AS source_file, CAST(close_date AS VARCHAR) AS feed_date,
               {REF} AS ref, p_name || ' ' || {REF} AS name, p_retailprice / 50 AS magnitude,
               {DMIN} AS dmin, {DMAX} AS dmax, p_partkey % 5 = 0 AS pha,
               p_partkey % 17 = 0 AS sentry, close_date
        FROM sightings JOIN part ON l_partkey = p_partkey
        UNION ALL
        SELECT {week_file('close_date')}, CAST(close_date + 1 AS VARCHAR),
               'S' || CAST(l_suppkey AS VARCHAR), 'quiet ' || CAST(l_suppkey AS VARCHAR),
               p_retailprice / 50, 0.25::DOUBLE, 0.5::DOUBLE, FALSE, p_partkey % 17 = 0, close_date
        FROM sightings JOIN part ON l_partkey = p_partkey""",
    "listed_approaches": f"""
        SELECT {week_file('close_date')} AS source_file, CAST(close_date AS VARCHAR) AS feed_date,
               day AS approach_position, {REF} AS ref, close_date + day AS close_approach_date,
               epoch + day * 86400000 AS epoch_date_close_approach,
               l_quantity * 0.5::DOUBLE AS velocity_km_per_s,
               l_quantity * 1800 AS velocity_km_per_h,
               {AU} * 149597870.7::DOUBLE AS miss_distance_km,
               {AU} AS miss_distance_astronomical, {AU} * 389.17::DOUBLE AS miss_distance_lunar,
               'Earth' AS orbiting_body,
               {hazard(DMAX, 'l_quantity * 0.5::DOUBLE', AU, 'p_partkey % 5 = 0')}
                   AS hazard_classification
        FROM sightings JOIN part ON l_partkey = p_partkey,
             (SELECT unnest([0, 1]) AS day)""",
    "weeks": """
        SELECT CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS batch_number,
               CAST(d AS DATE) AS batch_start, CAST(d AS DATE) + 6 AS batch_end,
               'asteroids_' || strftime(d, '%Y%m%d') || '_'
                   || strftime(CAST(d AS DATE) + 6, '%Y%m%d') || '.json' AS batch_file
        FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS d
              FROM (SELECT MIN(WEEK) AS lo, MAX(WEEK) AS hi
                    FROM (SELECT WEEKOF AS WEEK FROM sightings)))""".replace(
        "WEEKOF", week("close_date")
    ),
    "landed": f"""
        SELECT DISTINCT {week_file('close_date')} AS batch_file FROM sightings
        WHERE month({week('close_date')}) % 2 = 0""",
    "view": """
        SELECT a.*, t.name AS asteroid_name, t.neo_reference_id, t.is_potentially_hazardous,
               t.estimated_diameter_avg_km
        FROM approaches a JOIN asteroids t ON a.asteroid_id = t.id""",
    "candidates": """
        SELECT v.id AS approach_id, v.asteroid_name AS name, v.neo_reference_id,
               v.close_approach_date, v.miss_distance_km, v.velocity_km_per_h,
               v.hazard_classification, v.estimated_diameter_avg_km
        FROM view v LEFT JOIN alerts al ON v.id = al.approach_id AND al.alert_type = 'discord'
        WHERE (v.is_potentially_hazardous
               OR v.hazard_classification IN ('Hazardous', 'High', 'Critical'))
          AND al.approach_id IS NULL AND v.close_approach_date >= DATE '2001-10-01'
        ORDER BY v.close_approach_date, v.id LIMIT 100""",
    "minutes": """
        SELECT date_trunc('minute', ts) AS window_start, count(*) AS requests,
               count(*) FILTER (WHERE status BETWEEN 400 AND 599) AS errors,
               sum(duration_s) AS seconds
        FROM http_requests GROUP BY ALL""",
}


def sql(body: str) -> str:
    """`body` with the mapping tables it names, and the ones those name, as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {parts},\n{body.lstrip()[5:]}"
    return f"WITH {parts}\n{body}"


VIEW = """id, asteroid_name, CAST(close_approach_date AS VARCHAR) AS close_approach_date,
    velocity_km_per_h, miss_distance_km, hazard_classification, is_potentially_hazardous,
    estimated_diameter_avg_km"""
VELOCITY = "CAST(v.close_approach_date AS VARCHAR) AS date, asteroid_name, velocity_km_per_h"
RUNS = """id, source_file, started_at, completed_at, status, asteroids_processed,
    approaches_processed, error_message"""


def page(where: str, order: str, limit: int, offset: int) -> str:
    return f"""SELECT {VIEW} FROM view v WHERE {where}
        ORDER BY {order}, v.created_at DESC, v.id LIMIT {limit} OFFSET {offset}"""


def period(interval: str) -> str:
    return f"""SELECT {VELOCITY} FROM view v
        WHERE v.close_approach_date >= TIMESTAMP '2001-10-01 12:00:00' - INTERVAL {interval}"""


def histogram(source: str, labels: str, limits: list[float]) -> str:
    counts = ", ".join(
        f"count(*) FILTER (WHERE duration_s <= {limit}::DOUBLE)" for limit in limits
    )
    names = ", ".join(f"'{limit}'" for limit in limits)
    return f"""SELECT {labels}, unnest([{names}, '+Inf']) AS le,
            unnest([{counts}, count(*)]) AS bucket_count, count(*) AS count,
            round(sum(duration_s), 6) AS sum_s
        FROM {source} GROUP BY {labels}"""


MISS_TEXT = """CASE WHEN miss_distance_km >= 1000000
    THEN printf('%.2fM km', miss_distance_km / 1000000) ELSE printf('%.0f km', miss_distance_km) END"""
VELOCITY_TEXT = "printf('%.0f km/h', velocity_km_per_h)"
DIAMETER_TEXT = "printf('%.3f km', estimated_diameter_avg_km)"
COLOUR = """CASE hazard_classification WHEN 'Critical' THEN 255 * 65536 + 69 * 256 + 58
    WHEN 'High' THEN 255 * 65536 + 159 * 256 + 10 WHEN 'Medium' THEN 255 * 65536 + 214 * 256 + 10
    ELSE 48 * 65536 + 209 * 256 + 88 END"""


def number_text(value: str) -> str:
    return f"""CASE WHEN {value} >= 1000000 THEN printf('%.2fM', {value} / 1000000)
        WHEN {value} >= 1000 THEN printf('%.1fK', {value} / 1000)
        ELSE printf('%.0f', {value}) END"""


def _json_field(name: str, value: str) -> str:
    return f"""'{{"name":"{name}","value":"' || {value} || '","inline":true}}'"""


MESSAGE = (
    """'{"content":"' || CASE WHEN hazard_classification IN ('Critical', 'High')
        THEN '🚨 **HIGH ALERT: Potential Impact Risk Detected** 🚨'
        ELSE 'ℹ️ **Observation: New Near-Earth Object approach recorded**' END
    || '","title":"⚠️ Hazardous Asteroid Approach : ' || name
    || '","description":"🎯 **Target Identification:** `' || name || '`","color":' || """
    + f"CAST({COLOUR} AS VARCHAR) || ',\"fields\":[' || "
    + " || ',' || ".join(
        [
            _json_field("📡 Status", "'**' || hazard_classification || '**'"),
            _json_field("📅 Approach Date", "'`' || CAST(close_approach_date AS VARCHAR) || '`'"),
            _json_field("​", "'​'"),
            _json_field("📏 Miss Distance", f"'`' || {MISS_TEXT} || '`'"),
            _json_field("🚀 Velocity", f"'`' || {VELOCITY_TEXT} || '`'"),
            _json_field("🪨 Est. Diameter", f"'`' || {DIAMETER_TEXT} || '`'"),
        ]
    )
    + " || ']}'"
)

ORACLES: dict[str, str] = {
    # feed and records
    "feed_flatten_asteroids": f"""SELECT source_file, feed_date, {asteroid_id('ref')} AS id,
        ref AS neo_reference_id, name, magnitude AS absolute_magnitude,
        dmin AS estimated_diameter_min_km, dmax AS estimated_diameter_max_km,
        pha AS is_potentially_hazardous, sentry AS is_sentry_object,
        'sbdb/' || ref AS nasa_jpl_url, (dmin + dmax) / 2 AS estimated_diameter_avg_km
        FROM listed""",
    "feed_flatten_approaches": f"""SELECT source_file, feed_date,
        CAST(approach_position AS INTEGER) AS approach_position,
        {approach_id('ref', 'epoch_date_close_approach')} AS id, {asteroid_id('ref')} AS asteroid_id,
        CAST(close_approach_date AS VARCHAR) AS close_approach_date, epoch_date_close_approach,
        velocity_km_per_s, velocity_km_per_h, miss_distance_km, miss_distance_astronomical,
        miss_distance_lunar, orbiting_body, hazard_classification
        FROM listed_approaches""",
    "object_counts": f"""SELECT source_file, CAST(CASE WHEN contains(source_file, '03') THEN 3 ELSE 2 END AS BIGINT)
            AS declared_count, CAST(2 AS BIGINT) AS actual_count, NOT contains(source_file, '03') AS consistent
        FROM listed WHERE NOT starts_with(ref, 'S')""",
    "record_round_trip": f"""SELECT replace(source_file, '.json', '_transformed.json') AS source_file,
        {approach_id('ref', 'epoch_date_close_approach')} AS id, {asteroid_id('ref')} AS asteroid_id,
        CAST(close_approach_date AS VARCHAR) AS close_approach_date, epoch_date_close_approach,
        velocity_km_per_s, velocity_km_per_h, miss_distance_km, miss_distance_astronomical,
        miss_distance_lunar, orbiting_body, hazard_classification
        FROM listed_approaches""",
    "feed_date_range": """SELECT source_file, feed_date, ref AS neo_reference_id FROM listed
        WHERE feed_date BETWEEN '1998-01-01' AND '1998-06-30'""",
    "lenient_double": """SELECT l_orderkey, l_linenumber, l_partkey,
        kind IN (0, 1, 6, 7) AS accepted, kind = 7 AS is_nan,
        CASE WHEN kind IN (0, 1) THEN l_quantity WHEN kind = 6 THEN l_quantity * -100 END AS number
        FROM (SELECT *, (l_orderkey + l_linenumber) % 8 AS kind FROM lineitem)""",
    "ndjson_record_audit": """SELECT replace(source_file, '.json', '_transformed.json') AS source_file,
        count(*) FILTER (WHERE NOT sentry) AS valid_records,
        count(*) FILTER (WHERE sentry AND ref NOT LIKE 'S%') AS malformed_records,
        count(*) FILTER (WHERE sentry AND ref LIKE 'S%') AS blank_lines,
        count(*) FILTER (WHERE NOT sentry) > 0 AS loadable
        FROM listed GROUP BY source_file""",
    "pending_batches": """SELECT batch_number, CAST(batch_start AS VARCHAR) AS batch_start,
        CAST(batch_end AS VARCHAR) AS batch_end, batch_file
        FROM weeks WHERE batch_file NOT IN (SELECT batch_file FROM landed)""",
    "extraction_metadata": """WITH counts AS (
            SELECT source_file, count(*) AS n FROM listed
            WHERE source_file NOT LIKE 'asteroids_199803%' GROUP BY 1),
        results AS (
            SELECT w.*, l.batch_file IS NOT NULL AS skipped, c.n
            FROM weeks w LEFT JOIN landed l ON w.batch_file = l.batch_file
            LEFT JOIN counts c ON w.batch_file = c.source_file)
        SELECT CAST(min(batch_start) AS VARCHAR) AS start_date,
            CAST(max(batch_end) AS VARCHAR) AS end_date,
            CAST(coalesce(sum(n) FILTER (WHERE NOT skipped), 0) AS BIGINT) AS total_asteroids,
            count(*) AS total_batches,
            count(*) FILTER (WHERE skipped OR n IS NOT NULL) AS successful_batches,
            count(*) FILTER (WHERE NOT skipped AND n IS NULL) AS failed_batches,
            '2001-10-01T12:00:00Z' AS extracted_at, 'v1' AS nasa_api_version
        FROM results""",
    "date_batches": """SELECT o_orderpriority,
            CAST(step + 1 AS INTEGER) AS batch_number,
            CAST(lo + step * 7 AS VARCHAR) AS batch_start,
            CAST(least(lo + step * 7 + 6, hi) AS VARCHAR) AS batch_end,
            'asteroids_' || strftime(lo + step * 7, '%Y%m%d') || '_'
                || strftime(least(lo + step * 7 + 6, hi), '%Y%m%d') || '.json' AS batch_file
        FROM (SELECT *, CAST(unnest(range(0, date_diff('day', lo, hi) // 7 + 1)) AS INTEGER) AS step
              FROM (SELECT o_orderpriority, min(CAST(o_orderdate AS DATE)) AS lo,
                           max(CAST(o_orderdate AS DATE)) AS hi
                    FROM orders GROUP BY o_orderpriority))""",
    "transform_summary": f"""WITH todo AS (
            SELECT * FROM listed_approaches
            WHERE {week('CAST(feed_date AS DATE)')} >= DATE '1996-01-01'),
        files AS (SELECT DISTINCT {week('close_date')} AS begin FROM sightings)
        SELECT (SELECT count(*) FROM files WHERE begin >= DATE '1996-01-01') AS files_processed,
            (SELECT count(*) FROM files WHERE begin < DATE '1996-01-01') AS files_skipped,
            (SELECT count(*) FROM listed
             WHERE {week('close_date')} >= DATE '1996-01-01') AS total_asteroids,
            count(*) AS total_approaches,
            count(*) FILTER (WHERE hazard_classification = 'Critical') AS critical_count,
            count(*) FILTER (WHERE hazard_classification = 'High') AS high_count,
            count(*) FILTER (WHERE hazard_classification = 'Medium') AS medium_count,
            count(*) FILTER (WHERE hazard_classification = 'Low') AS low_count
        FROM todo""",
    "load_summary": f"""WITH files AS (SELECT DISTINCT {week('close_date')} AS begin FROM sightings),
        objects AS (SELECT DISTINCT source_file, ref FROM listed
                    WHERE {week('close_date')} >= DATE '1996-01-01'),
        arrivals AS (SELECT ref, epoch_date_close_approach AS epoch FROM listed_approaches
                     WHERE {week('CAST(feed_date AS DATE)')} >= DATE '1996-01-01'),
        known AS (SELECT DISTINCT {REF} AS ref, epoch FROM firsts
                  WHERE close_date < DATE '1997-01-01'),
        added AS (SELECT DISTINCT ref, epoch FROM arrivals ANTI JOIN known USING (ref, epoch))
        SELECT (SELECT count(*) FROM files WHERE begin >= DATE '1996-01-01') AS files_processed,
            (SELECT count(*) FROM files WHERE begin < DATE '1996-01-01') AS files_skipped,
            (SELECT count(*) FROM objects) AS asteroids_upserted,
            (SELECT count(*) FROM added) AS approaches_inserted,
            (SELECT count(*) FROM arrivals) - (SELECT count(*) FROM added) AS approaches_skipped""",
    "upsert_stats": f"""WITH objects AS (SELECT DISTINCT ref FROM listed),
        known_objects AS (SELECT neo_reference_id AS ref FROM asteroids WHERE is_sentry_object),
        arrivals AS (SELECT ref, epoch_date_close_approach AS epoch FROM listed_approaches),
        known AS (SELECT DISTINCT {REF} AS ref, epoch FROM firsts
                  WHERE close_date < DATE '1997-01-01'),
        added AS (SELECT DISTINCT ref, epoch FROM arrivals ANTI JOIN known USING (ref, epoch))
        SELECT (SELECT count(*) FROM objects ANTI JOIN known_objects USING (ref))
                AS asteroids_inserted,
            (SELECT count(*) FROM objects SEMI JOIN known_objects USING (ref)) AS asteroids_updated,
            (SELECT count(*) FROM added) AS approaches_inserted,
            (SELECT count(*) FROM arrivals) - (SELECT count(*) FROM added) AS approaches_skipped""",
    # chains over files
    "landing_round_trip": f"""SELECT {batch_name('close_date')} AS source_file, count(*) AS documents,
            count(*) AS objects, count(*) AS consistent
        FROM sightings JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "landed_range": """SELECT CAST(close_date AS VARCHAR) AS feed_date, count(*) AS objects
        FROM sightings JOIN part ON l_partkey = p_partkey
        WHERE close_date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' GROUP BY close_date""",
    "file_chain": f"""WITH seen AS (
            SELECT {batch_name('close_date')} AS source_file, {REF} AS ref, epoch
            FROM sightings JOIN part ON l_partkey = p_partkey),
        files AS (
            SELECT source_file, count(*) AS documents, count(DISTINCT ref) AS objects,
                   source_file = 'asteroids_19971228_19980328.json' AS broken,
                   source_file = 'asteroids_19980329_19980627.json' AS bare
            FROM seen GROUP BY source_file),
        credited AS (
            SELECT file AS source_file, count(*) AS n
            FROM (SELECT min(source_file) AS file FROM seen
                  WHERE source_file NOT IN ('asteroids_19971228_19980328.json', 'asteroids_19980329_19980627.json')
                  GROUP BY ref, epoch)
            GROUP BY 1)
        SELECT f.source_file, CASE WHEN broken THEN documents ELSE 0 END AS rejected_documents,
            NOT broken AS announced, bare AS pending,
            CASE WHEN bare THEN 'failed' WHEN NOT broken THEN 'completed' END AS status,
            CAST(CASE WHEN bare THEN 0 WHEN NOT broken THEN objects END AS INTEGER) AS asteroids_processed,
            CAST(CASE WHEN bare THEN 0 WHEN NOT broken THEN coalesce(n, 0) END AS INTEGER) AS approaches_processed,
            CASE WHEN bare THEN 'No valid records found in file' END AS error_message
        FROM files f LEFT JOIN credited c USING (source_file)""",
    "streamed_load": """SELECT CAST(day AS VARCHAR) AS close_approach_date, count(*) AS approaches,
            count(DISTINCT l_partkey) AS asteroids
        FROM (SELECT DISTINCT l_partkey, epoch, close_date AS day
              FROM sightings JOIN part ON l_partkey = p_partkey)
        GROUP BY day""",
    # expressions
    "hazard_classify": "SELECT id, hazard_classification FROM approaches",
    "asteroid_uuid5": "SELECT id, neo_reference_id FROM asteroids",
    "approach_uuid5": "SELECT id, asteroid_id, epoch_date_close_approach FROM approaches",
    "diameter_avg": "SELECT id, estimated_diameter_avg_km FROM asteroids",
    "enum_normalise": """SELECT o_orderkey, status, status = 'running' AS is_running,
            status = 'completed' AS is_completed, status = 'failed' AS is_failed, hazard,
            CAST(CASE hazard WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2
                ELSE 3 END AS INTEGER) AS severity
        FROM (SELECT o_orderkey,
                CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed'
                    ELSE 'running' END AS status,
                CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'High'
                    WHEN '4' THEN 'Medium' ELSE 'Low' END AS hazard
              FROM orders)""",
    "fmt_number": f"""SELECT o_orderkey, {number_text('(o_totalprice * 10)')} AS large,
        {number_text('o_totalprice')} AS medium, {number_text('(o_totalprice / 1000)')} AS small
        FROM orders""",
    "fmt_alert_fields": f"""SELECT id AS approach_id, {MISS_TEXT} AS miss_text,
        {VELOCITY_TEXT} AS velocity_text, {DIAMETER_TEXT} AS diameter_text,
        CAST({COLOUR} AS INTEGER) AS colour FROM view""",
    "approach_display_row": f"""SELECT id, asteroid_name,
        strftime(close_approach_date, '%b ') || lpad(CAST(day(close_approach_date) AS VARCHAR), 2, ' ')
            || strftime(close_approach_date, ', %Y') AS approach_date,
        printf('%.0fK km/h', velocity_km_per_h / 1000) AS velocity,
        printf('%.2fM km', miss_distance_km / 1000000) AS miss_distance,
        {DIAMETER_TEXT} AS avg_diameter, hazard_classification FROM view""",
    # reads
    "recent_approaches": page("TRUE", "v.close_approach_date DESC", 50, 0),
    "approach_asteroid_join": f"SELECT {VIEW}, neo_reference_id FROM view",
    "asteroid_lookup": f"""SELECT id, neo_reference_id, name, absolute_magnitude, nasa_jpl_url
        FROM asteroids WHERE neo_reference_id IN
            (SELECT {REF} FROM lineitem WHERE l_quantity = 50)""",
    "approaches_page": page("TRUE", "v.close_approach_date DESC", 20, 40),
    "approaches_page_date_range": page(
        "v.close_approach_date >= DATE '1997-01-01' AND v.close_approach_date < DATE '1997-04-01'",
        "v.close_approach_date DESC", 20, 20,
    ),
    "approaches_page_hazard": page(
        "v.hazard_classification = 'Critical'", "v.close_approach_date DESC", 20, 40
    ),
    "approaches_page_all_filters": page(
        "v.close_approach_date >= DATE '1996-01-01' AND v.close_approach_date < DATE '2000-01-01' "
        "AND v.hazard_classification = 'High'",
        "v.velocity_km_per_h ASC", 25, 25,
    ),
    "approaches_sort_velocity": page("TRUE", "v.velocity_km_per_h DESC", 20, 0),
    "approaches_sort_distance": page("TRUE", "v.miss_distance_km ASC", 20, 0),
    "approaches_sort_name": page("TRUE", "v.asteroid_name ASC", 20, 20),
    "approaches_sort_hazard": page("TRUE", "v.hazard_classification DESC", 20, 0),
    "approaches_sort_date": page("TRUE", "v.close_approach_date ASC", 20, 0),
    "approaches_page_deep": f"""SELECT {VIEW} FROM view v
        QUALIFY (row_number() OVER (ORDER BY v.close_approach_date DESC, v.created_at DESC, v.id) - 1) // 20
            = count(*) OVER () // 2 // 20""",
    "approaches_page_total": """SELECT count(*) AS total_items,
            CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages,
            CAST(greatest(ceil(count(*) / 20), 1) AS BIGINT) AS table_pages
        FROM view v WHERE v.close_approach_date >= DATE '1996-01-01'
            AND v.close_approach_date < DATE '2000-01-01' AND v.hazard_classification = 'High'""",
    "velocity_latest": f"""SELECT {VELOCITY} FROM view v
        ORDER BY v.close_approach_date DESC, v.id LIMIT 100""",
    "velocity_date_range": f"""SELECT {VELOCITY} FROM view v
        WHERE v.close_approach_date BETWEEN DATE '1998-02-01' AND DATE '1998-02-14'""",
    "velocity_period_7d": period("7 DAY"),
    "velocity_period_30d": period("30 DAY"),
    "velocity_period_90d": period("90 DAY"),
    "velocity_period_1y": period("1 YEAR"),
    "daily_avg_velocity": """SELECT CAST(a.close_approach_date AS VARCHAR) AS date,
        avg(velocity_km_per_h) AS avg_velocity_km_per_h
        FROM approaches a GROUP BY a.close_approach_date""",
    "velocity_chart": """SELECT CAST(a.close_approach_date AS VARCHAR) AS date,
        strftime(a.close_approach_date, '%d %b %Y') AS label, round(avg(velocity_km_per_h), 6) AS velocity
        FROM approaches a GROUP BY a.close_approach_date""",
    "velocity_chart_empty": """WITH slow AS (SELECT * FROM approaches WHERE velocity_km_per_h < 0)
        SELECT CAST(a.close_approach_date AS VARCHAR) AS date,
        strftime(a.close_approach_date, '%d %b %Y') AS label, round(avg(velocity_km_per_h), 6) AS velocity
        FROM slow a GROUP BY a.close_approach_date
        UNION ALL SELECT NULL, 'No Data Available', 0.0 WHERE NOT EXISTS (SELECT * FROM slow)""",
    "count_asteroids": "SELECT count(*) AS total_asteroids FROM asteroids",
    "count_approaches": "SELECT count(*) AS total_approaches FROM approaches",
    "count_hazardous": """SELECT count(*) AS hazardous_count FROM asteroids
        WHERE is_potentially_hazardous""",
    "dashboard_stats": """SELECT (SELECT count(*) FROM asteroids) AS total_asteroids,
        (SELECT count(*) FROM approaches) AS total_approaches,
        (SELECT count(*) FROM asteroids WHERE is_potentially_hazardous) AS hazardous_count""",
    "hazard_breakdown": """SELECT c AS hazard_classification, count(a.id) AS approaches
        FROM (SELECT unnest(['Critical', 'High', 'Medium', 'Low']) AS c)
        LEFT JOIN approaches a ON a.hazard_classification = c GROUP BY c""",
    "count_etl_runs": "SELECT count(*) AS total_runs FROM etl_events",
    "recent_etl_runs": f"SELECT {RUNS} FROM etl_events ORDER BY started_at DESC, id LIMIT 20",
    "etl_runs_page": f"""SELECT {RUNS} FROM etl_events
        ORDER BY started_at DESC, id LIMIT 20 OFFSET 20""",
    "etl_runs_total": """SELECT count(*) AS total_runs, CAST(ceil(count(*) / 10) AS BIGINT) AS total_pages
        FROM etl_events""",
    "last_etl_run": """SELECT epoch_ms(max(completed_at)) // 1000 AS last_etl_run FROM etl_events
        WHERE status = 'completed'""",
    # merges and the ledger
    "upsert_asteroids": f"""WITH incoming AS (
            SELECT p_partkey, p_size, p_name || ' rev ' || CAST(l_orderkey AS VARCHAR) AS name,
                   l_quantity
            FROM lineitem JOIN part ON l_partkey = p_partkey
            QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY l_shipdate DESC,
                l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC,
                name DESC) = 1),
        stored AS (
            SELECT a.* FROM asteroids a JOIN part ON a.neo_reference_id = {PART_REF}
            WHERE p_type <> 'ECONOMY'),
        fresh AS (
            SELECT {asteroid_id(PART_REF)} AS id, {PART_REF} AS ref, name, l_quantity AS magnitude,
                   CAST(p_size AS DOUBLE) / 160 AS dmin, CAST(p_size AS DOUBLE) / 40 AS dmax,
                   l_quantity > 25 AS pha, TIMESTAMP '2001-10-01 12:00:00' AS moment FROM incoming)
        SELECT coalesce(s.id, f.id) AS id, coalesce(s.neo_reference_id, ref) AS neo_reference_id,
            coalesce(f.name, s.name) AS name, coalesce(magnitude, absolute_magnitude) AS absolute_magnitude,
            coalesce(dmin, estimated_diameter_min_km) AS estimated_diameter_min_km,
            coalesce(dmax, estimated_diameter_max_km) AS estimated_diameter_max_km,
            coalesce(pha, is_potentially_hazardous) AS is_potentially_hazardous,
            CASE WHEN f.id IS NOT NULL THEN TRUE ELSE is_sentry_object END AS is_sentry_object,
            'sbdb/' || coalesce(s.neo_reference_id, ref) AS nasa_jpl_url,
            coalesce(created_at, moment) AS created_at, coalesce(moment, updated_at) AS updated_at,
            (coalesce(dmin, estimated_diameter_min_km) + coalesce(dmax, estimated_diameter_max_km)) / 2
                AS estimated_diameter_avg_km
        FROM stored s FULL JOIN fresh f ON s.neo_reference_id = f.ref""",
    "upsert_approaches": """SELECT id, asteroid_id,
        CAST(close_approach_date AS VARCHAR) AS close_approach_date, epoch_date_close_approach,
        velocity_km_per_h, miss_distance_km, miss_distance_astronomical, miss_distance_lunar,
        CASE WHEN a.close_approach_date < DATE '1997-01-01' THEN 'Low'
            ELSE hazard_classification END AS hazard_classification, created_at
        FROM approaches a""",
    "fk_orphans": """SELECT 'approaches' AS child, id FROM approaches
        WHERE asteroid_id NOT IN (SELECT id FROM asteroids WHERE NOT is_sentry_object)
        UNION ALL
        SELECT 'alerts', id FROM alerts WHERE approach_id NOT IN
            (SELECT id FROM approaches WHERE close_approach_date >= DATE '1997-01-01')""",
    "cascade_delete": """WITH gone AS (SELECT id FROM asteroids WHERE is_sentry_object),
        lost AS (SELECT id FROM approaches WHERE asteroid_id IN (SELECT id FROM gone))
        SELECT 'asteroids' AS kept_in, id FROM asteroids WHERE id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'approaches', id FROM approaches WHERE id NOT IN (SELECT id FROM lost)
        UNION ALL SELECT 'alerts', id FROM alerts WHERE approach_id NOT IN (SELECT id FROM lost)""",
    "etl_events_latest": f"""SELECT {uuid5(NS_ASTEROID, "('etl:' || source_file)")} AS id, *
        FROM (SELECT {ORDER_FILE.format('o_orderkey')} AS source_file,
            CASE WHEN again THEN o_orderdate + INTERVAL 24 HOUR ELSE o_orderdate END AS started_at,
            CASE WHEN again AND even THEN o_orderdate + INTERVAL 25 HOUR
                WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at,
            CASE WHEN again AND even THEN CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'completed' END
                WHEN again THEN 'running'
                ELSE CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed'
                    ELSE 'failed' END END AS status,
            CAST(CASE WHEN again AND even AND o_orderstatus <> 'F' THEN small + 3
                WHEN o_orderstatus = 'F' THEN small + 1 ELSE 0 END AS INTEGER) AS asteroids_processed,
            CAST(CASE WHEN again AND even AND o_orderstatus <> 'F' THEN small * 2 + 3
                WHEN o_orderstatus = 'F' THEN small * 2 + 1 ELSE 0 END AS INTEGER)
                AS approaches_processed,
            CASE WHEN (again AND even AND o_orderstatus = 'F')
                    OR (NOT again AND o_orderstatus = 'P')
                THEN 'error ' || CAST(o_orderkey AS VARCHAR) END AS error_message
        FROM (SELECT *, o_orderkey % 3 = 0 AS again, o_orderkey % 2 = 0 AS even,
                     CAST(floor(o_totalprice / 1000) AS INTEGER) AS small FROM orders))""",
    "files_already_processed": f"""SELECT DISTINCT {ORDER_FILE.format('l_orderkey')} AS source_file
        FROM lineitem WHERE {ORDER_FILE.format('l_orderkey')} IN
            (SELECT source_file FROM etl_events WHERE status = 'completed')""",
    "pending_files": f"""SELECT DISTINCT {ORDER_FILE.format('l_orderkey')} AS source_file
        FROM lineitem WHERE {ORDER_FILE.format('l_orderkey')} NOT IN
            (SELECT source_file FROM etl_events WHERE status = 'completed')""",
    # alerts
    "alert_candidates": """SELECT approach_id, name, neo_reference_id,
        CAST(close_approach_date AS VARCHAR) AS close_approach_date, miss_distance_km,
        velocity_km_per_h, hazard_classification, estimated_diameter_avg_km FROM candidates""",
    "alerts_anti_join": """SELECT a.id, CAST(close_approach_date AS VARCHAR) AS close_approach_date
        FROM approaches a
        LEFT JOIN alerts al ON a.id = al.approach_id AND al.alert_type = 'discord'
        WHERE al.id IS NULL""",
    "alert_payload": f"SELECT approach_id, {MESSAGE} AS message FROM candidates",
    "alert_outbox": f"""SELECT approach_id, 'discord' AS alert_type, {MESSAGE} AS message,
        FALSE AS delivered FROM candidates""",
    "record_alerts": f"""SELECT {alert_id('a.id', "'discord'")} AS id, a.id AS approach_id,
        'discord' AS alert_type, TIMESTAMP '2001-10-01 12:00:00' AS alerted_at,
        '{{"status":"sent"}}' AS payload
        FROM approaches a WHERE a.hazard_classification IN ('Critical', 'High')
        AND a.id NOT IN (SELECT approach_id FROM alerts WHERE alert_type = 'discord')""",
    # telemetry
    "http_requests_total": """SELECT method, path, status, count(*) AS total
        FROM http_requests GROUP BY ALL""",
    "db_queries_total": """SELECT operation, status, count(*) AS total
        FROM db_queries GROUP BY ALL""",
    "http_duration_histogram": histogram(
        "http_requests", "method, path, status",
        [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0],
    ),
    "db_duration_histogram": histogram(
        "db_queries", "operation, status",
        [0.0001, 0.0005, 0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0],
    ),
    "requests_per_second": """SELECT window_start, requests / 60 AS requests_per_second
        FROM minutes""",
    "error_rate_percent": """SELECT window_start, errors / requests * 100 AS error_rate_percent
        FROM minutes""",
    "avg_response_time_ms": """SELECT window_start,
        round(seconds / requests * 1000, 6) AS avg_response_time_ms FROM minutes""",
    "streamed_rates": """SELECT window_start, requests / 60 AS requests_per_second,
        errors / requests * 100 AS error_rate_percent,
        round(seconds / requests * 1000, 6) AS avg_response_time_ms FROM minutes""",
    "db_queries_per_second": """SELECT date_trunc('minute', ts) AS window_start,
        count(*) / 60 AS db_queries_per_second FROM db_queries GROUP BY 1""",
    "error_rate_class": """SELECT window_start,
        printf('%.3f%%', errors / requests * 100) AS error_rate,
        CASE WHEN errors / requests * 100 > 5 THEN 'critical'
            WHEN errors / requests * 100 > 1 THEN 'high' ELSE 'low' END AS error_rate_class
        FROM minutes""",
    "metrics_summary": """WITH log AS (
            SELECT * FROM http_requests
            WHERE ts > TIMESTAMP '2024-01-02 04:02:00' AND ts <= TIMESTAMP '2024-01-02 04:03:00')
        SELECT count(*) / 60 AS requests_per_second,
            coalesce(count(*) FILTER (WHERE status BETWEEN 400 AND 599) / nullif(count(*), 0) * 100, 0)
                AS error_rate_percent,
            round(coalesce(sum(duration_s) / nullif(count(*), 0) * 1000, 0), 6)
                AS avg_response_time_ms,
            (SELECT count(*) / 60 FROM db_queries WHERE ts > TIMESTAMP '2024-01-02 04:02:00'
                AND ts <= TIMESTAMP '2024-01-02 04:03:00') AS db_queries_per_second,
            (SELECT count(*) FROM asteroids) AS total_asteroids,
            (SELECT count(*) FROM approaches) AS total_approaches,
            (SELECT count(*) FROM asteroids WHERE is_potentially_hazardous) AS hazardous_count,
            (SELECT epoch_ms(max(completed_at)) // 1000 FROM etl_events
             WHERE status = 'completed') AS last_etl_run
        FROM log""",
    "metric_texts": """WITH log AS (
            SELECT * FROM http_requests
            WHERE ts > TIMESTAMP '2024-01-02 04:02:00' AND ts <= TIMESTAMP '2024-01-02 04:03:00'),
        rates AS (
            SELECT count(*) / 60 AS per_second, coalesce(sum(duration_s) / nullif(count(*), 0) * 1000, 0) AS ms,
                coalesce(count(*) FILTER (WHERE status BETWEEN 400 AND 599) / nullif(count(*), 0) * 100, 0) AS errors,
                (SELECT count(*) / 60 FROM db_queries WHERE ts > TIMESTAMP '2024-01-02 04:02:00'
                    AND ts <= TIMESTAMP '2024-01-02 04:03:00') AS queries
            FROM log)
        SELECT printf('%.3f', per_second) AS requests_per_second, printf('%.3f%%', errors) AS error_rate_percent,
            CASE WHEN errors > 5 THEN 'critical' WHEN errors > 1 THEN 'high' ELSE 'low' END AS error_rate_class,
            printf('%.3f ms', ms) AS avg_response_time_ms, printf('%.3f', queries) AS db_queries_per_second
        FROM rates""",
}


def oracle_sql() -> dict[str, str]:
    return {name: sql(body) for name, body in ORACLES.items()}
