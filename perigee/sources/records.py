"""Transformed records: one JSON line `[asteroid, [approach, ...]]` per object.

Decoded frames have `source_file`, `asteroid`, `approaches` and `state`, which is one of
`valid`, `malformed`, `blank`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.hazard import HAZARD_CLASSES
from ..functions.numbers import is_finite
from ..functions.once import evaluate_in_steps
from .feed import JSON_OPTIONS, average_diameter, to_date_strict
from .listing import files, write_lines

UUID_PATTERN = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
INSTANT_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})\z"
)
INSTANT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
BLANKS = " \t\r\n\x0b\x0c"
SUFFIX = "_transformed.json"


def line_source() -> Column:
    """The source file of a line being read: the partition of its file, or the file's name."""
    part = F.regexp_extract(F.col("_metadata.file_path"), r"/source_file=([^/]+)/[^/]+\z", 1)
    return F.when(part != "", part).otherwise(F.col("_metadata.file_name"))


def scan_record_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Lines written by `write_records`; `source_file` is the partition column."""
    return spark.read.schema("value string, source_file string").text(folder)


def record_files(spark: SparkSession, folder: str) -> DataFrame:
    """`source_file` and `path` of the record files of a folder; nothing is read."""
    return files(spark, folder, lambda name: name.endswith(SUFFIX)).select("source_file", "path")


def transformed_name(source_file: Column) -> Column:
    return F.concat(F.regexp_replace(source_file, r"\.json\z", ""), F.lit(SUFFIX))


def _json_ready(struct_type: T.StructType, value: Column) -> Column:
    """NaN and infinities have no JSON spelling; they are written as null."""
    fields = []
    for field in struct_type.fields:
        item = value[field.name]
        if isinstance(field.dataType, T.DoubleType):
            item = F.when(is_finite(item), item)
        fields.append(item.alias(field.name))
    return F.struct(*fields)


def encode_records(records: DataFrame) -> DataFrame:
    """`source_file` (renamed to its transformed name) and `value`, the line. The row that
    `feed_objects` keeps of a document without objects is a blank line."""
    asteroid_type = records.schema["asteroid"].dataType
    approach_type = records.schema["approaches"].dataType.elementType
    options = {"ignoreNullFields": "false", "timestampFormat": INSTANT_FORMAT}
    head = F.to_json(_json_ready(asteroid_type, F.col("asteroid")), options)
    tail = F.to_json(
        F.transform("approaches", lambda item: _json_ready(approach_type, item)), options
    )
    line = F.concat(F.lit("["), head, F.lit(","), tail, F.lit("]"))
    return records.select(
        transformed_name(F.col("source_file")).alias("source_file"), F.coalesce(line, F.lit("")).alias("value")
    )


def write_records(records: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A folder per source file. Tasks write what they read; no shuffle gathers a file."""
    write_lines(encode_records(records), folder, ["source_file"], overwrite)


def _instant(text: Column) -> Column:
    return F.when(text.rlike(INSTANT_PATTERN), text.try_cast("timestamp"))


_TYPED = {
    "close_approach_date",
    "created_at",
    "updated_at",
    "id",
    "asteroid_id",
    "hazard_classification",
}


def _restructure(struct_type: T.StructType, value: Column) -> Column:
    fields = []
    for field in struct_type.fields:
        if field.name in _TYPED:
            item = _typed_one(value, field.name)
        elif isinstance(field.dataType, T.DoubleType):
            item = F.when(is_finite(value[field.name]), value[field.name])
        else:
            item = value[field.name]
        fields.append(item.alias(field.name))
    return F.struct(*fields)


def _typed_one(value: Column, name: str) -> Column:
    text = value[name]
    if name == "close_approach_date":
        return to_date_strict(text)
    if name in ("created_at", "updated_at"):
        return _instant(text)
    if name == "hazard_classification":
        return F.when(text.isin(*HAZARD_CLASSES), text)
    return F.when(text.rlike(UUID_PATTERN), F.lower(text))


def _complete(struct_type: T.StructType, value: Column) -> Column:
    check = value.isNotNull()
    for name in struct_type.names:
        check = check & value[name].isNotNull()
    return F.coalesce(check, F.lit(False))


def decode_records(lines: DataFrame) -> DataFrame:
    """Parse lines; bad ones are kept and marked, so they can be counted and skipped."""
    line = F.col("value")
    # trimming goes through all characters of a line
    whole = line.startswith("[") & line.endswith("]")
    text = F.when(whole, line).otherwise(F.btrim(line, F.lit(BLANKS)))
    typed = evaluate_in_steps(
        lines.select("source_file", text.alias("text")).select("source_file", "text", (F.col("text") == "").alias("blank")),
        F.from_json("text", "array<string>", JSON_OPTIONS),
        lambda pair: F.struct(
            F.size(pair).alias("parts"),
            F.from_json(F.get(pair, F.lit(0)), schemas.ASTEROID_RECORD, JSON_OPTIONS).alias("a"),
            F.from_json(F.get(pair, F.lit(1)), T.ArrayType(schemas.APPROACH_RECORD), JSON_OPTIONS).alias("p"),
        ),
        lambda held: F.struct(
            held["parts"].alias("parts"),
            _restructure(schemas.ASTEROID_RECORD, held["a"]).alias("asteroid"),
            F.transform(held["p"], lambda item: _restructure(schemas.APPROACH_RECORD, item)).alias("approaches"),
        ),
    )
    whole_list = F.coalesce(
        F.forall("approaches", lambda item: _complete(schemas.APPROACH_RECORD, item)), F.lit(False)
    )
    valid = (
        F.coalesce(F.col("parts") == 2, F.lit(False))
        & _complete(schemas.ASTEROID_RECORD, F.col("asteroid"))
        & whole_list
    )
    state = F.when(F.col("blank"), "blank").when(valid, "valid").otherwise("malformed")
    return typed.select("source_file", "asteroid", "approaches", state.alias("state"))


def record_audit(decoded: DataFrame) -> DataFrame:
    """Lines per file and state; a file without one valid record has failed."""
    counts = decoded.groupBy("source_file").agg(
        F.count_if(F.col("state") == "valid").alias("valid_records"),
        F.count_if(F.col("state") == "malformed").alias("malformed_records"),
        F.count_if(F.col("state") == "blank").alias("blank_lines"),
    )
    return counts.withColumn("loadable", F.col("valid_records") > 0)


def record_asteroids(decoded: DataFrame) -> DataFrame:
    """Asteroid rows of the valid records."""
    valid = decoded.filter(F.col("state") == "valid")
    return valid.select("source_file", "asteroid.*").select("*", average_diameter())


def record_approaches(decoded: DataFrame) -> DataFrame:
    """Approach rows of the valid records."""
    valid = decoded.filter(F.col("state") == "valid")
    return valid.select("source_file", F.inline("approaches"))
