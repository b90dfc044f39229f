"""Schemas of the stored tables and of the two JSON wire formats."""

from __future__ import annotations

from pyspark.sql import types as T


_SIMPLE = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
}


def _fields(spec: str, **nested: T.DataType) -> T.StructType:
    """Struct from `name type` pairs; a type in `nested` goes by its name there.

    Unlike a DDL string this needs no running session.
    """
    fields = []
    for pair in spec.split(","):
        name, kind = pair.split()
        fields.append(T.StructField(name, nested.get(kind) or _SIMPLE[kind]))
    return T.StructType(fields)


ASTEROIDS = _fields(
    """
    id string, neo_reference_id string, name string, absolute_magnitude double,
    estimated_diameter_min_km double, estimated_diameter_max_km double,
    is_potentially_hazardous boolean, is_sentry_object boolean, nasa_jpl_url string,
    created_at timestamp, updated_at timestamp, estimated_diameter_avg_km double
    """
)

APPROACHES = _fields(
    """
    id string, asteroid_id string, close_approach_date date,
    epoch_date_close_approach bigint, velocity_km_per_s double, velocity_km_per_h double,
    miss_distance_km double, miss_distance_astronomical double, miss_distance_lunar double,
    orbiting_body string, hazard_classification string, created_at timestamp
    """
)

ETL_EVENTS = _fields(
    """
    id string, source_file string, started_at timestamp, completed_at timestamp,
    status string, asteroids_processed int, approaches_processed int, error_message string
    """
)

ALERTS = _fields(
    "id string, approach_id string, alert_type string, alerted_at timestamp, payload string"
)

HTTP_REQUESTS = _fields(
    "ts timestamp, method string, path string, status int, duration_s double"
)

DB_QUERIES = _fields("ts timestamp, operation string, status string, duration_s double")

TABLES = {
    "asteroids": ASTEROIDS,
    "approaches": APPROACHES,
    "etl_events": ETL_EVENTS,
    "alerts": ALERTS,
}

# Wire format of one feed document. Velocities and distances may arrive as text or as
# numbers, so they are read as text; every other field keeps its JSON type, and a value of
# the wrong type decodes to NULL, which the required-field checks then reject.
_DIAMETER = _fields("estimated_diameter_min double, estimated_diameter_max double")

CLOSE_APPROACH = _fields(
    """
    close_approach_date string, close_approach_date_full string,
    epoch_date_close_approach bigint, relative_velocity velocities,
    miss_distance distances, orbiting_body string
    """,
    velocities=_fields(
        "kilometers_per_second string, kilometers_per_hour string, miles_per_hour string"
    ),
    distances=_fields("astronomical string, lunar string, kilometers string, miles string"),
)

NEO = _fields(
    """
    links links, id string, neo_reference_id string, name string, nasa_jpl_url string,
    absolute_magnitude_h double, estimated_diameter diameters,
    is_potentially_hazardous_asteroid boolean, close_approach_data approaches,
    is_sentry_object boolean, sentry_data string
    """,
    links=_fields("self string"),
    diameters=_fields(
        "kilometers range, meters range, miles range, feet range", range=_DIAMETER
    ),
    approaches=T.ArrayType(CLOSE_APPROACH),
)

FEED = _fields(
    "links links, element_count bigint, near_earth_objects days",
    links=_fields("next string, previous string, self string"),
    days=T.MapType(T.StringType(), T.ArrayType(NEO)),
)

# One line of a transformed file is the pair [asteroid, [approach, ...]].
ASTEROID_RECORD = _fields(
    """
    id string, neo_reference_id string, name string, absolute_magnitude double,
    estimated_diameter_min_km double, estimated_diameter_max_km double,
    is_potentially_hazardous boolean, is_sentry_object boolean, nasa_jpl_url string,
    created_at string, updated_at string
    """
)

APPROACH_RECORD = _fields(
    """
    id string, asteroid_id string, close_approach_date string,
    epoch_date_close_approach bigint, velocity_km_per_s double, velocity_km_per_h double,
    miss_distance_km double, miss_distance_astronomical double, miss_distance_lunar double,
    orbiting_body string, hazard_classification string, created_at string
    """
)
