"""Number parsing and cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JVM also reads hexadecimal numbers and the suffixes of Java literals; the inputs do not mean them.
_JAVA_ONLY = r"(?i)^\s*[+-]?0x|[0-9.][df]\s*$"


def to_number(c: Column) -> Column:
    """Text to DOUBLE, null where it is not a number."""
    text = c.cast("string")
    return F.when(~text.rlike(_JAVA_ONLY), text.try_cast("double"))


def parse_decimal_comma(c: Column) -> Column:
    """``'-12,5'`` -> ``-12.5``; anything unreadable becomes null."""
    return to_number(F.replace(c.cast("string"), F.lit(","), F.lit(".")))


def number_or_zero(c: Column) -> Column:
    """Number with null and NaN filled by 0."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def clean_metric(c: Column, error_floor: float | None = -900.0, *, numeric: bool = False) -> Column:
    """0.0 for null, unreadable, NaN, infinite values and for error codes at or below ``error_floor``.

    Pass ``numeric=True`` for columns that already are DOUBLE: the text round trip is left out.
    """
    value = c if numeric else to_number(c)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    if error_floor is not None:
        bad = bad | (value <= error_floor)
    return F.when(bad, 0.0).otherwise(value)


def percent_gain(cold: Column, warm: Column) -> Column:
    """Relative gain of ``warm`` over ``cold`` in percent, 2 decimals; 0 if there is no cold time."""
    gain = F.round((cold - warm) / F.nullif(cold, F.lit(0.0)) * 100, 2)
    return F.when(cold > 0, gain).otherwise(0.0)


def two_decimals(c: Column) -> Column:
    return F.format_string("%.2f", c)
