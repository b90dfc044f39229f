"""Texts shown to people: numbers, table cells, alert fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import fixed

# Class colours as red, green, blue; the last entry serves every other class.
HAZARD_COLOURS = {
    "Critical": (255, 69, 58),
    "High": (255, 159, 10),
    "Medium": (255, 214, 10),
    "Low": (48, 209, 88),
}

# Alert texts.
ALERT_TITLE = "⚠️ Hazardous Asteroid Approach"
ALERT_BANNER_URGENT = "🚨 **HIGH ALERT: Potential Impact Risk Detected** 🚨"
ALERT_BANNER_CALM = "ℹ️ **Observation: New Near-Earth Object approach recorded**"
ALERT_TARGET = "🎯 **Target Identification:** "
ALERT_FIELD_STATUS = "📡 Status"
ALERT_FIELD_DATE = "📅 Approach Date"
ALERT_FIELD_DISTANCE = "📏 Miss Distance"
ALERT_FIELD_VELOCITY = "🚀 Velocity"
ALERT_FIELD_DIAMETER = "🪨 Est. Diameter"
ALERT_FIELD_SPACER = "\u200b"

# Error-rate limits in percent.
ERROR_RATE_CRITICAL = 5.0
ERROR_RATE_HIGH = 1.0


def _at_least(value: Column, limit: float) -> Column:
    return (value >= F.lit(limit)) & ~F.isnan(value)


def format_number(value: Column) -> Column:
    """Millions with two places, thousands with one, else whole units.

    The unit is chosen before rounding, so 999999 prints as `1000.0K`.
    """
    return (
        F.when(_at_least(value, 1e6), F.concat(fixed(value / F.lit(1e6), 2), F.lit("M")))
        .when(_at_least(value, 1e3), F.concat(fixed(value / F.lit(1e3), 1), F.lit("K")))
        .otherwise(fixed(value, 0))
    )


def miss_distance_text(km: Column) -> Column:
    return F.when(
        _at_least(km, 1e6), F.concat(fixed(km / F.lit(1e6), 2), F.lit("M km"))
    ).otherwise(F.concat(fixed(km, 0), F.lit(" km")))


def velocity_text(km_per_h: Column) -> Column:
    return F.concat(fixed(km_per_h, 0), F.lit(" km/h"))


def diameter_text(km: Column) -> Column:
    return F.concat(fixed(km, 3), F.lit(" km"))


def hazard_colour(hazard: Column) -> Column:
    """Colour as one 24-bit number."""
    packed = {name: r * 65536 + g * 256 + b for name, (r, g, b) in HAZARD_COLOURS.items()}
    colour = F.lit(packed["Low"])
    for name, number in packed.items():
        colour = F.when(hazard == name, F.lit(number)).otherwise(colour)
    return colour


def alert_banner(hazard: Column) -> Column:
    return F.when(hazard.isin("Critical", "High"), F.lit(ALERT_BANNER_URGENT)).otherwise(
        F.lit(ALERT_BANNER_CALM)
    )


def _bold(text: Column) -> Column:
    return F.concat(F.lit("**"), text, F.lit("**"))


def _code(text: Column) -> Column:
    return F.concat(F.lit("`"), text, F.lit("`"))


def _field(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(True).alias("inline"))


def alert_document(
    name: Column, hazard: Column, date: Column, miss_km: Column, km_per_h: Column, diameter: Column
) -> Column:
    """The message as JSON text."""
    fields = F.array(
        _field(ALERT_FIELD_STATUS, _bold(hazard)),
        _field(ALERT_FIELD_DATE, _code(date.cast("string"))),
        _field(ALERT_FIELD_SPACER, F.lit(ALERT_FIELD_SPACER)),
        _field(ALERT_FIELD_DISTANCE, _code(miss_distance_text(miss_km))),
        _field(ALERT_FIELD_VELOCITY, _code(velocity_text(km_per_h))),
        _field(ALERT_FIELD_DIAMETER, _code(diameter_text(diameter))),
    )
    return F.to_json(
        F.struct(
            alert_banner(hazard).alias("content"),
            F.concat(F.lit(ALERT_TITLE + " : "), name).alias("title"),
            F.concat(F.lit(ALERT_TARGET), _code(name)).alias("description"),
            hazard_colour(hazard).alias("color"),
            fields.alias("fields"),
        )
    )


def table_date(date: Column) -> Column:
    """`Jan  5, 2024`: the day is padded with a blank to two places."""
    day = F.lpad(F.dayofmonth(date).cast("string"), 2, " ")
    return F.concat(F.date_format(date, "MMM "), day, F.date_format(date, ", yyyy"))


def table_velocity(km_per_h: Column) -> Column:
    return F.concat(fixed(km_per_h / F.lit(1e3), 0), F.lit("K km/h"))


def table_distance(km: Column) -> Column:
    return F.concat(fixed(km / F.lit(1e6), 2), F.lit("M km"))


def error_rate_class(percent: Column) -> Column:
    exceeds = lambda limit: (percent > F.lit(limit)) & ~F.isnan(percent)
    return (
        F.when(exceeds(ERROR_RATE_CRITICAL), F.lit("critical"))
        .when(exceeds(ERROR_RATE_HIGH), F.lit("high"))
        .otherwise(F.lit("low"))
    )


def rate_text(value: Column) -> Column:
    return fixed(value, 3)


def total_pages(total: Column, page_size: int, empty_pages: int = 0) -> Column:
    """Pages needed for `total` rows; an empty result has `empty_pages`."""
    if page_size < 1:
        raise ValueError("page_size must be at least 1")
    return F.greatest(F.ceil(total / F.lit(page_size)), F.lit(empty_pages)).cast("bigint")
