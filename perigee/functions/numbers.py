"""Reading doubles from loose text and printing them with exact rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The accepted spellings of a number.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INFINITY_PATTERN = r"^(?i)[+-]?inf(inity)?\z"
NAN_PATTERN = r"^(?i)[+-]?nan\z"


def lenient_double(text: Column) -> Column:
    """Number carried as JSON text or JSON number; NULL for anything else.

    Stricter than a cast on purpose: surrounding blanks and type suffixes are refused.
    """
    infinity = F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (
        F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
        .when(text.rlike(INFINITY_PATTERN), infinity)
        .when(text.rlike(NAN_PATTERN), F.lit(float("nan")))
    )


def strict_double(text: Column, field: str = "value") -> Column:
    """As `lenient_double`, but the query fails on text that is no number."""
    message = F.concat(F.lit(f"{field}: not a number: "), F.coalesce(text, F.lit("NULL")))
    return F.coalesce(lenient_double(text), F.raise_error(message).cast("double"))


def is_finite(value: Column) -> Column:
    """True for real numbers only: not NULL, not NaN, not infinite."""
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def fixed(value: Column, decimals: int) -> Column:
    """`value` with `decimals` places, rounding the exact binary value half to even.

    `format_string` rounds the shortest decimal spelling half up and would print 2.5 as 3
    and 0.15 as 0.2; `format_number` with a pattern knows the exact value.
    """
    pattern = "0." + "0" * decimals if decimals else "0"
    text = F.call_function("format_number", value, F.lit(pattern))
    return F.replace(text, F.lit("∞"), F.lit("inf"))
