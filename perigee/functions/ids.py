"""Deterministic identifiers: name-based (version 5) UUIDs as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .once import evaluate_once

# The namespaces every stored identifier is derived from.
ASTEROID_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
APPROACH_NAMESPACE = "7cb8c921-aebe-22e2-91c5-11d15fe541d9"
PACKABLE = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def name_digest(namespace: str, name: Column) -> Column:
    """The hash a version-5 UUID is cut from, as 40 hex digits."""
    seed = F.unhex(F.lit(namespace.replace("-", "")))
    return F.sha1(F.concat(seed, name.cast("binary")))


def digest_uuid(digest: Column) -> Column:
    """The version-5 UUID of a hash, as lower-case text."""
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version-5 UUID of `name`."""
    return digest_uuid(name_digest(namespace, name))


def packed_uuid(text: Column) -> Column:
    """A lower-case UUID as 16 bytes after a zero byte, any other text as its own after a one."""
    digits = F.unhex(F.replace(text, F.lit("-"), F.lit("")))
    return F.when(text.rlike(PACKABLE), F.concat(F.unhex(F.lit("00")), digits)).otherwise(
        F.concat(F.unhex(F.lit("01")), text.cast("binary"))
    )


def unpacked_uuid(packed: Column) -> Column:
    """The text that `packed_uuid` was given."""
    rest = F.substring(packed, 2, 2147483647)
    digits = F.lower(F.hex(rest))
    parts = [F.substring(digits, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    is_uuid = F.substring(packed, 1, 1) == F.unhex(F.lit("00"))
    return F.when(is_uuid, F.concat_ws("-", *parts)).otherwise(rest.cast("string"))


def approach_name(neo_reference_id: Column, epoch_ms: Column) -> Column:
    return F.concat(neo_reference_id, F.lit(":"), epoch_ms.cast("string"))


def asteroid_id(neo_reference_id: Column) -> Column:
    return uuid5(ASTEROID_NAMESPACE, neo_reference_id)


def approach_id(neo_reference_id: Column, epoch_ms: Column) -> Column:
    return uuid5(APPROACH_NAMESPACE, approach_name(neo_reference_id, epoch_ms))


def with_identifiers(rows: DataFrame, reference: Column, epoch_ms: Column | None = None) -> DataFrame:
    """Add `asteroid_id` and, given an instant, the approach's `id`.

    The hash is computed once per row here. Left as a plain expression it would be repeated
    in every join key and filter the identifier gets into.
    """
    hashes = {"_asteroid": name_digest(ASTEROID_NAMESPACE, reference)}
    if epoch_ms is not None:
        hashes["_approach"] = name_digest(APPROACH_NAMESPACE, approach_name(reference, epoch_ms))
    hashed = evaluate_once(rows, **hashes)
    columns = [digest_uuid(F.col("_asteroid")).alias("asteroid_id")]
    if epoch_ms is not None:
        columns.append(digest_uuid(F.col("_approach")).alias("id"))
    return hashed.select(*rows.columns, *columns)


def alert_id(approach: Column, channel: Column) -> Column:
    """Derived rather than random, so a retried task writes the same identifier."""
    return uuid5(APPROACH_NAMESPACE, F.concat(F.lit("alert:"), channel, F.lit(":"), approach))


def ledger_id(source_file: Column) -> Column:
    return uuid5(ASTEROID_NAMESPACE, F.concat(F.lit("etl:"), source_file))
