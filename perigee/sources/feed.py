"""Raw feed documents: scan, decode, check, flatten.

A frame of documents has the columns `source_file` and `document` (JSON text). Decoding adds
`feed` and `decode_error`; a document with any error yields no rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.hazard import classify_hazard
from ..functions.ids import (
    APPROACH_NAMESPACE,
    ASTEROID_NAMESPACE,
    approach_name,
    digest_uuid,
    name_digest,
)
from ..functions.numbers import is_finite, lenient_double
from ..functions.once import evaluate_once
from .batches import batch_file
from .listing import write_lines

DATE_PATTERN = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"
JSON_OPTIONS = {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"}
U32_MAX = 4294967295


def scan_feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per `*.json` file of a folder; names that start with `_` are not data."""
    return (
        spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
        .select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("document"))
    )


def read_landed(
    spark: SparkSession,
    folder: str,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Documents landed by `land`, with only the batch folders that touch the range."""
    landed = spark.read.schema(
        "value string, batch_start date, batch_end date"
    ).text(folder, wholetext=False)
    if start is not None:
        landed = landed.filter(F.col("batch_end") >= F.lit(start))
    if end is not None:
        landed = landed.filter(F.col("batch_start") <= F.lit(end))
    name = batch_file(F.col("batch_start"), F.col("batch_end"))
    return landed.select(name.alias("source_file"), F.col("value").alias("document"))


def read_files(spark: SparkSession, whole: list[str], landed: list[str]) -> DataFrame:
    """Documents of files of one document each, and of files of landed batches."""
    file = F.col("_metadata.file_path")
    parts = []
    if whole:
        read = spark.read.text(whole, wholetext=True)
        parts.append(read.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("document")))
    if landed:
        day = lambda end: F.to_date(F.regexp_extract(file, rf"/batch_{end}=([0-9-]+)/", 1))
        name = batch_file(day("start"), day("end"))
        read = spark.read.text(landed)
        parts.append(read.select(name.alias("source_file"), F.col("value").alias("document")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def land(documents: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Write documents (with `batch_start`, `batch_end`) one per line, a folder per batch.

    Rows stay where they are: no shuffle, so a heavy batch is written by many tasks.
    """
    one_line = F.regexp_replace("document", r"[\r\n]+", " ").alias("value")
    write_lines(documents.select(one_line, "batch_start", "batch_end"), folder, ["batch_start", "batch_end"], overwrite)


def to_date_strict(text: Column) -> Column:
    return F.when(text.rlike(DATE_PATTERN), text.try_cast("date"))


def _all(*checks: Column) -> Column:
    result = F.lit(True)
    for check in checks:
        result = result & check
    return result


def _given(parent: Column, *names: str) -> Column:
    return _all(*[parent[name].isNotNull() for name in names])


def _every(array: Column, check) -> Column:
    """True if the array is there and every element passes; NULL elements fail."""
    passes = F.forall(array, lambda item: F.coalesce(item.isNotNull() & check(item), F.lit(False)))
    return F.coalesce(array.isNotNull() & passes, F.lit(False))


def _velocities(item: Column) -> list[Column]:
    return [item["relative_velocity"][f"{unit}_per_{time}"] for unit, time in (("kilometers", "second"), ("kilometers", "hour"), ("miles", "hour"))]


def _distances(item: Column) -> list[Column]:
    return [item["miss_distance"][unit] for unit in ("astronomical", "lunar", "kilometers", "miles")]


def _sizes(neo: Column) -> list[Column]:
    spans = [neo["estimated_diameter"][unit] for unit in ("kilometers", "meters", "miles", "feet")]
    return [neo["absolute_magnitude_h"], *[span[f"estimated_diameter_{end}"] for span in spans for end in ("min", "max")]]


_OBJECT_TEXTS = ("id", "neo_reference_id", "name", "nasa_jpl_url")
_FLAGS = ("is_potentially_hazardous_asteroid", "is_sentry_object")
_ITEM_TEXTS = ("close_approach_date_full", "orbiting_body")


def _item_ok(item: Column) -> Column:
    numbers = [lenient_double(text).isNotNull() for text in _velocities(item) + _distances(item)]
    day = to_date_strict(item["close_approach_date"]).isNotNull()
    return _given(item, *_ITEM_TEXTS, "epoch_date_close_approach") & day & _all(*numbers)


def _object_ok(neo: Column) -> Column:
    given = _given(neo, *_OBJECT_TEXTS, *_FLAGS) & neo["links"]["self"].isNotNull()
    return given & _all(*[is_finite(size) for size in _sizes(neo)]) & _every(neo["close_approach_data"], _item_ok)


def _let(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a value that is made once, whatever uses it, by code of its own: the JVM
    compiles no long code."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _with_plain(parsed: DataFrame) -> DataFrame:
    """Add `plain`, which is true only if all objects and approaches of a document pass `_object_ok` and
    have their numbers in plain digits; else it says nothing. Lambdas are interpreted, node by node for
    each object and approach, so they are left to the documents of which this does not know; arrays
    of the values of a field are compiled.

    `array_contains` of a value that is not there is false without NULLs, else NULL; where the
    value is there, the answer is left to `_object_ok` too.
    """
    whole = lambda array, absent: ~F.array_contains(array, absent)
    objects, items = F.col("objects"), F.col("items")
    rows = _let(parsed, "objects", F.flatten(F.map_values(F.col("feed")["near_earth_objects"])))
    rows = _let(rows, "items", F.flatten(objects["close_approach_data"]))
    texts = [objects[name] for name in _OBJECT_TEXTS] + [objects["links"]["self"]] + [items[name] for name in _ITEM_TEXTS]
    rows = _let(rows, "texts", F.concat(*texts, items["close_approach_date"]))
    rows = _let(rows, "flags", F.concat(*[objects[name] for name in _FLAGS]).cast("array<int>"))
    rows = _let(rows, "sizes", F.concat(*_sizes(objects)))
    rows = _let(rows, "numbers", F.concat(*_velocities(items), *_distances(items)))
    days, texts, sizes, numbers = items["close_approach_date"], F.col("texts"), F.col("sizes"), F.col("numbers")
    given = whole(texts, "\0 absent \0") & whole(F.col("flags"), 2) & whole(items["epoch_date_close_approach"], -9223372036854775807)
    finite = whole(sizes, float("inf")) & (F.array_max(sizes) < F.lit(float("inf"))) & (F.array_min(sizes) > F.lit(float("-inf")))
    # of these characters alone, a cast takes the same texts as `lenient_double`
    digits = whole(numbers, "\0 absent \0") & F.concat_ws("", numbers).rlike(r"^[0-9.eE+-]*\z")
    # a text with a comma is no date to a cast
    day = DATE_PATTERN.removeprefix("^").removesuffix(r"\z")
    dated = F.concat_ws(",", days).rlike(rf"^({day}(,{day})*)?\z")
    rows = _let(rows, "given", given & finite)
    rows = _let(rows, "digits", digits & whole(numbers.try_cast("array<double>"), -4.9e-324))
    rows = _let(rows, "dated", dated & whole(days.try_cast("array<date>"), F.lit("0001-01-01").cast("date")))
    return rows.withColumn("plain", F.coalesce(F.col("given") & F.col("digits") & F.col("dated"), F.lit(False)))


def decode_feed(documents: DataFrame) -> DataFrame:
    """Parse each document once and say in `decode_error` why it is unusable, if it is.

    `days` has the listed objects by day, as they were parsed. The permissive parser turns bad
    nested values into NULL without a word, so every required field is checked here.
    """
    feed = F.col("feed")
    head = F.ltrim("document").substr(1, 1).alias("head")
    parsed = _let(
        documents.select("source_file", "document", head), "feed", F.from_json("document", schemas.FEED, JSON_OPTIONS)
    )
    # made together: a row that has no days is not to be left out below the check
    checked = evaluate_once(
        _with_plain(parsed.select("source_file", "head", "feed")).select("source_file", "head", "feed", "plain"),
        parsed=feed.isNotNull(),
        linked=feed["links"]["self"].isNotNull(),
        element_count=feed["element_count"],
        near=feed["near_earth_objects"],
        usable=F.when(F.col("plain"), True),
    )
    days = F.map_entries("near")
    error = (
        F.when(~F.col("parsed") | (F.col("head") != "{"), "not a JSON object")
        .when(~F.col("linked"), "links.self is missing")
        .when(
            ~F.coalesce(F.col("element_count").between(0, U32_MAX), F.lit(False)),
            "element_count is missing or no count",
        )
        .when(F.col("near").isNull(), "near_earth_objects is missing")
        .when(
            ~F.coalesce("usable", _every(days, lambda held: _every(held["value"], _object_ok))),
            "an object lacks a required field or has one of the wrong type",
        )
    )
    return checked.select("source_file", "element_count", days.alias("days"), error.alias("decode_error"))


def rejects(decoded: DataFrame) -> DataFrame:
    """The unusable documents: `source_file` and why."""
    return decoded.filter(F.col("decode_error").isNotNull()).select("source_file", "decode_error")


def valid_feeds(decoded: DataFrame, strict: bool = True) -> DataFrame:
    """Usable documents. Strict: the first bad one fails the query and names its file."""
    if not strict:
        return decoded.filter(F.col("decode_error").isNull())
    message = F.concat(F.lit("cannot read "), F.col("source_file"), F.lit(": "), F.col("decode_error"))
    checked = F.when(F.col("decode_error").isNull(), F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean")
    )
    return decoded.filter(checked)


def feed_objects(
    feeds: DataFrame, start: dt.date | None = None, end: dt.date | None = None, keep_empty: bool = False
) -> DataFrame:
    """One row per listed object: `source_file`, `feed_date`, `position`, `neo`.

    The day under which an object is listed only selects rows here and orders duplicates. With
    `keep_empty` a document that lists no object has one row, whose `neo` is NULL.
    """
    held = F.col("days")
    if keep_empty:
        kind = feeds.schema["days"].dataType.elementType
        nothing = F.struct(F.lit(None).cast("string").alias("key"),
                           F.array(F.lit(None).cast(kind["value"].dataType.elementType)).alias("value"))
        held = F.when(listed(held) == 0, F.array(nothing)).otherwise(held)
    days = feeds.select("source_file", F.inline(held).alias("feed_date", "objects"))
    day = to_date_strict(F.col("feed_date"))
    if start is not None:
        days = days.filter(day >= F.lit(start))
    if end is not None:
        days = days.filter(day <= F.lit(end))
    return days.select(
        "source_file", "feed_date", F.posexplode("objects").alias("position", "neo")
    )


def listed(days: Column) -> Column:
    """Objects of a document, without unfolding it."""
    return F.size(F.flatten(days["value"])).cast("bigint")


def object_counts(feeds: DataFrame) -> DataFrame:
    """Declared and actual number of listed objects per document."""
    return feeds.select(
        "source_file",
        F.col("element_count").alias("declared_count"),
        listed(F.col("days")).alias("actual_count"),
    ).withColumn("consistent", F.col("declared_count") == F.col("actual_count"))


def object_values(neo: Column) -> dict[str, Column]:
    """Fields of an asteroid, of an object of a usable document."""
    km = neo["estimated_diameter"]["kilometers"]
    return {
        "neo_reference_id": neo["neo_reference_id"],
        "name": neo["name"],
        "absolute_magnitude": neo["absolute_magnitude_h"],
        "estimated_diameter_min_km": km["estimated_diameter_min"],
        "estimated_diameter_max_km": km["estimated_diameter_max"],
        "is_potentially_hazardous": neo["is_potentially_hazardous_asteroid"],
        "is_sentry_object": neo["is_sentry_object"],
        "nasa_jpl_url": neo["nasa_jpl_url"],
    }


def item_values(item: Column) -> dict[str, Column]:
    """Fields of an approach, of one in a usable document: there a cast that finds a number or a
    date is right, and only the spellings that it does not know are left."""
    number = lambda text: F.coalesce(text.try_cast("double"), lenient_double(text))
    per_second, per_hour, _ = _velocities(item)
    astronomical, lunar, kilometers, _ = _distances(item)
    return {
        "close_approach_date": item["close_approach_date"].try_cast("date"),
        "epoch_date_close_approach": item["epoch_date_close_approach"],
        "velocity_km_per_s": number(per_second),
        "velocity_km_per_h": number(per_hour),
        "miss_distance_km": number(kilometers),
        "miss_distance_astronomical": number(astronomical),
        "miss_distance_lunar": number(lunar),
        "orbiting_body": item["orbiting_body"],
    }


def hazard_of(neo: dict[str, Column], item: dict[str, Column]) -> Column:
    return classify_hazard(
        neo["estimated_diameter_max_km"],
        item["velocity_km_per_s"],
        item["miss_distance_astronomical"],
        neo["is_potentially_hazardous"],
    )


def merge_keys(objects: DataFrame) -> DataFrame:
    """What a merge goes by: `source_file`, `reference`, `asteroid_id`, `epoch`; a row for each
    listed object (NULL epoch) and for each of its approaches."""
    neo = F.col("neo")
    hashed = evaluate_once(
        objects.select("source_file", "neo"), digest=name_digest(ASTEROID_NAMESPACE, neo["neo_reference_id"])
    )
    epochs = F.concat(
        F.array(F.lit(None).cast("bigint")), neo["close_approach_data"]["epoch_date_close_approach"]
    )
    return hashed.select(
        "source_file",
        neo["neo_reference_id"].alias("reference"),
        digest_uuid(F.col("digest")).alias("asteroid_id"),
        F.explode(epochs).alias("epoch"),
    )


def _asteroid_fields(neo: dict[str, Column], now: Column, identifier: Column) -> list[Column]:
    kept = [value.alias(name) for name, value in neo.items()]
    return [identifier.alias("id"), *kept, now.alias("created_at"), now.alias("updated_at")]


def _approach_fields(item: dict[str, Column], hazard: Column, now: Column, identifier: Column, parent: Column) -> list[Column]:
    kept = [value.alias(name) for name, value in item.items()]
    return [
        identifier.alias("id"),
        parent.alias("asteroid_id"),
        *kept,
        hazard.alias("hazard_classification"),
        now.alias("created_at"),
    ]


def average_diameter() -> Column:
    """The stored average is always recomputed from its two inputs."""
    low, high = F.col("estimated_diameter_min_km"), F.col("estimated_diameter_max_km")
    return ((low + high) / F.lit(2.0)).alias("estimated_diameter_avg_km")


def _flat_objects(objects: DataFrame, **more: Column) -> tuple[DataFrame, dict[str, Column]]:
    """Objects with their fields as columns, and these columns."""
    values = object_values(F.col("neo"))
    flat = objects.select(
        "source_file", "feed_date", "position", *[value.alias(name) for name, value in (values | more).items()]
    )
    return flat, {name: F.col(name) for name in values}


def asteroid_rows(objects: DataFrame, now: Column) -> DataFrame:
    """One asteroid row per listed object, duplicates included."""
    flat, own = _flat_objects(objects)
    hashed = evaluate_once(flat, digest=name_digest(ASTEROID_NAMESPACE, F.col("neo_reference_id")))
    rows = hashed.select(
        "source_file", "feed_date", "position", *_asteroid_fields(own, now, digest_uuid(F.col("digest")))
    )
    return rows.select("*", average_diameter())


def approach_rows(objects: DataFrame, now: Column) -> DataFrame:
    """One row per close approach; an object without any yields none.

    Both hashes are made once: an identifier is cut from six parts of its own, and without
    this each would hash again. That of the object is made before its approaches are listed.
    """
    flat, own = _flat_objects(objects, approaches=F.col("neo")["close_approach_data"])
    listed = evaluate_once(flat, parent=name_digest(ASTEROID_NAMESPACE, F.col("neo_reference_id")))
    needed = ["neo_reference_id", "estimated_diameter_max_km", "is_potentially_hazardous"]
    place = ["source_file", "feed_date", "position"]
    each = listed.select(
        *place, *needed, "parent", F.posexplode("approaches").alias("approach_position", "item")
    )
    item = item_values(F.col("item"))
    name = approach_name(F.col("neo_reference_id"), item["epoch_date_close_approach"])
    hashed = evaluate_once(
        each, digest=name_digest(APPROACH_NAMESPACE, name),
        **{name: item[name] for name in ("velocity_km_per_s", "miss_distance_astronomical")},
    )
    item = {name: F.col(name) if name in hashed.columns else value for name, value in item.items()}
    ids = digest_uuid(F.col("digest")), digest_uuid(F.col("parent"))
    return hashed.select(*place, "approach_position", *_approach_fields(item, hazard_of(own, item), now, *ids))


def records(objects: DataFrame, now: Column) -> DataFrame:
    """One row per listed object, its approaches nested: `asteroid`, `approaches`.

    Identifiers are cut from hashes made before: inside a lambda nothing would keep the hash
    from being made again for every part of the identifier.
    """
    flat, own = _flat_objects(objects, listed=F.col("neo")["close_approach_data"])
    reference = F.col("neo_reference_id")
    digest = lambda item: name_digest(
        APPROACH_NAMESPACE, approach_name(reference, item["epoch_date_close_approach"])
    )
    hashed = evaluate_once(
        flat,
        digest=name_digest(ASTEROID_NAMESPACE, reference),
        items=F.transform(
            "listed",
            lambda item: F.struct(*[value.alias(name) for name, value in item_values(item).items()], digest(item).alias("digest")),
        ),
    )
    parent = digest_uuid(F.col("digest"))

    def approach(held: Column) -> Column:
        item = {name: held[name] for name in item_values(held)}
        return F.struct(*_approach_fields(item, hazard_of(own, item), now, digest_uuid(held["digest"]), parent))

    return hashed.select(
        "source_file",
        "feed_date",
        "position",
        F.struct(*_asteroid_fields(own, now, parent)).alias("asteroid"),
        F.transform("items", approach).alias("approaches"),
    )
