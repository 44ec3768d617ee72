"""Lenient parsing as column expressions: bad text becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARIS = "Europe/Paris"
BLANKS = " \t\n\r\x0b\x0c"

# Number text: optional sign, digits with an optional point, optional exponent.
# A plain cast would also take a type suffix such as '12f'.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INFINITE = r"^[+-]?(?i:inf|infinity)\z"
# ISO date, or date and time with optional seconds, fraction and zone.
ISO = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?\z"
)
NO_SECONDS = r"^(.{16})(?!:)"
DIGITS = r"^[0-9]+\z"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def number_from_text(text: Column) -> Column:
    plain = strip(text)
    return (
        F.when(plain.rlike(NUMBER), plain.try_cast("double"))
        .when(plain.rlike(INFINITE), F.when(plain.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    )


def instant_from_text(text: Column) -> Column:
    """ISO text to an instant; text without a zone is UTC, which is the session zone."""
    plain = strip(text)
    # Spark's own parser wants seconds.
    full = F.regexp_replace(plain, NO_SECONDS, "$1:00")
    return F.when(plain.rlike(ISO), full.try_cast("timestamp"))


def to_number(df: DataFrame, name: str) -> Column:
    """A double; text that is no number and NaN become null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return number_from_text(F.col(name))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(name), F.col(name).cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.col(name).cast("double")
    return F.lit(None).cast("double")


def to_instant(df: DataFrame, name: str) -> Column:
    """A UTC instant; naive time is taken as UTC (the session zone is UTC)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return instant_from_text(F.col(name))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp")
    return F.lit(None).cast("timestamp")


def to_paris(instant: Column) -> Column:
    """Paris wall clock, a value without a zone: only fields may be derived from it."""
    return F.from_utc_timestamp(instant, PARIS).cast("timestamp_ntz")


def json_text(df: DataFrame, name: str, keep_text: bool) -> Column:
    """Nested values as compact JSON text; text is kept or dropped; anything else is null."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(F.col(name))
    if isinstance(kind, T.StringType) and keep_text:
        return F.col(name)
    return F.lit(None).cast("string")


def hours(n: int | float) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def is_digits(text: Column) -> Column:
    """ASCII digits only, over the whole value; null is not valid."""
    return F.coalesce(text.rlike(DIGITS), F.lit(False))
