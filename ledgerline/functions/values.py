"""Parsing and normalising of single values. Bad input becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A full date is required, so that a bare year or a number is not taken for a time.
ISO_TIME = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"
ZONED_TIME = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)? ?(Z|[+-]\d{2}:?\d{2})$"
SLASH_DATE = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(.*)$"
#: Rewritten before parsing, each to the ISO order or to four digits of the year.
SHAPES = [
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?=$|[ T])", "$1-$2-$3"),
    (r"^((?:19|20)\d{2})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(\d{1,2}[/.-]\d{1,2}[/.-])(\d{2})(?=$|[ T])", "$120$2"),
    (r"^(\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2})$", "$1:00"),
]
HALF_DAY = [("y-M-d h:mm a", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2} [AP]M$"), ("y-M-d h:mm:ss a", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2} [AP]M$")]
MONTH_NAMES = ["MMM d, y", "MMMM d, y", "d MMM y", "d MMMM y"]
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def timestamp_from_text(text: Column, day_first: bool = False, formats: tuple[str, ...] = ()) -> Column:
    """``timestamp_ntz`` from ISO text, from ``d/m/y`` or ``m/d/y`` dates, or from given formats.

    For slash dates the preferred order is tried first and the other one if that is no date. Also read: year first with
    slashes, eight digits, two-digit years (2000 on), hours alone, AM and PM, English month names. A time with an offset is
    turned to UTC.
    """
    trimmed = F.trim(text)
    for shape, replacement in SHAPES:
        trimmed = F.regexp_replace(trimmed, shape, replacement)

    def iso(value: Column) -> Column:
        upper = F.upper(value)
        halves = [F.try_to_timestamp(F.when(upper.rlike(shape), upper), F.lit(f)).cast("timestamp_ntz") for f, shape in HALF_DAY]
        return F.coalesce(F.when(value.rlike(ISO_TIME), value).try_cast("timestamp_ntz"), *halves)

    zoned = F.when(trimmed.rlike(ZONED_TIME), trimmed).try_cast("timestamp")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.cast("timestamp_ntz"))
    named = F.when(trimmed.rlike("[A-Za-z]{3}"), F.initcap(trimmed))

    orders = ["$3-$2-$1$4", "$3-$1-$2$4"]
    if not day_first:
        orders.reverse()
    candidates = [iso(trimmed)]
    candidates += [iso(F.regexp_replace(trimmed, SLASH_DATE, order)) for order in orders]
    candidates.append(utc)
    candidates += [F.try_to_timestamp(named, F.lit(f)).cast("timestamp_ntz") for f in MONTH_NAMES]
    candidates += [F.try_to_timestamp(F.trim(text), F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*candidates)


def finite(number: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def number_from_text(text: Column, currency: bool = False) -> Column:
    if currency:
        text = F.regexp_replace(text, "[$,]", "")
    trimmed = F.trim(text)
    return finite(F.when(trimmed.rlike(PLAIN_NUMBER), trimmed).try_cast("double"))


def normal_text(text: Column) -> Column:
    """Lower case, punctuation to blanks, runs of blanks to one, trimmed; NULL to ''."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def as_timestamp(df: DataFrame, name: str, day_first: bool = False, formats: tuple[str, ...] = ()) -> Column:
    """Column ``name`` as ``timestamp_ntz``, parsed only when it is text."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return timestamp_from_text(F.col(name), day_first, formats)
    return F.col(name).cast("timestamp_ntz")


def as_number(df: DataFrame, name: str, currency: bool = False) -> Column:
    """Column ``name`` as a finite double, parsed only when it is text."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return number_from_text(F.col(name), currency)
    return finite(F.col(name).cast("double"))
