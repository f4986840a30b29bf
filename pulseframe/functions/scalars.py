"""Coercion, null-handling and date expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamp layouts found in the exports, tried in this order.
TIMESTAMP_LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss Z",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(text: Column | str) -> Column:
    """String to double; anything that is not a number becomes NULL."""
    number = as_column(text).try_cast("double")
    return F.when(~F.isnan(number), number)


def to_whole(text: Column | str) -> Column:
    """Numeric string to int, fraction cut off; not a number becomes NULL."""
    return to_number(text).try_cast("int")


def to_instant(text: Column | str) -> Column:
    """Timestamp string with or without an offset to an instant; bad text becomes NULL."""
    c = as_column(text)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(layout)) for layout in TIMESTAMP_LAYOUTS])


def wall_clock_date(text: Column | str) -> Column:
    """The date the wearer saw: the date prefix of the string, whatever its offset."""
    return F.substring(as_column(text), 1, 10).try_cast("date")


def elapsed(start: Column | str, end: Column | str, unit_seconds: int) -> Column:
    """Time between two instants in units of ``unit_seconds``."""
    micros = F.unix_micros(as_column(end)) - F.unix_micros(as_column(start))
    return micros / F.lit(unit_seconds * 1_000_000.0)


def hours_between(start: Column | str, end: Column | str) -> Column:
    return elapsed(start, end, 3600)


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return elapsed(start, end, 60)


def given(c: Column | str) -> Column:
    """True when a metric was reported; zero counts as not reported, as does NULL."""
    c = as_column(c)
    return c.isNotNull() & (c != 0)


def given_below(c: Column | str, threshold: float) -> Column:
    return given(c) & (as_column(c) < threshold)


def given_above(c: Column | str, threshold: float) -> Column:
    return given(c) & (as_column(c) > threshold)


def given_at_least(c: Column | str, threshold: float) -> Column:
    return given(c) & (as_column(c) >= threshold)


def or_else(c: Column | str, default: object) -> Column:
    return F.coalesce(as_column(c), F.lit(default))


def optional(columns: list[str], name: str, data_type: str) -> Column:
    """Column ``name`` when the input has it, otherwise a typed NULL."""
    if name in columns:
        return F.col(name)
    return F.lit(None).cast(data_type)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over the pairs where both sides are present.

    NULL when either side is constant; the built-in raises there under ANSI mode.
    """
    x, y = as_column(x), as_column(y)
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), spread)


def dot(left: Column, right: Column) -> Column:
    """Inner product of two numeric arrays."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def one_decimal(x: Column) -> Column:
    """A non-negative double as text with one decimal, rounded by its exact binary value.

    Ten times the value is kept as a sum plus its rounding error; the sign of the error
    settles what looks like a half. Real halves go to the even digit.
    """
    whole = 8 * x + 2 * x
    error = (8 * x - whole) + 2 * x
    low = F.floor(whole)
    part = whole - low
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
    return ((low + up.cast("int")) / 10).cast("string")


def to_places(x: Column | str, places: int) -> Column:
    """A double to so many decimals, as SQL engines without decimal arithmetic round it: the multiple by
    a power of ten goes to the nearest whole number, halves away from zero. ``F.round`` takes the
    shortest decimal text instead, so 0.145, a little less in binary, becomes 0.15 there, here 0.14."""
    scaled = as_column(x) * F.lit(10.0**places)
    part = scaled % 1
    step = F.when(part >= 0.5, 1.0).when(part <= -0.5, -1.0).otherwise(0.0)
    return (scaled - part + step) / F.lit(10.0**places)
