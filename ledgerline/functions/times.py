"""Calendar parts of a ``timestamp_ntz``. None of them depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_DAY = 86_400_000_000

# Last hour of each period of the day, then the names in order.
PERIOD_LAST_HOUR = {"Night": 6, "Morning": 12, "Afternoon": 18, "Evening": 23}
# Days in calendar order.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 as a long."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    fraction = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return seconds * 1_000_000 + fraction


def whole_days(micros: Column) -> Column:
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("long")


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def week_label(ts: Column) -> Column:
    """Monday and Sunday of the week as ``YYYY-MM-DD/YYYY-MM-DD``."""
    monday = F.trunc(F.to_date(ts), "week")
    return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))


def month_label(ts: Column) -> Column:
    return F.substring(F.to_date(ts).cast("string"), 1, 7)


def day_name(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.weekday(ts) + 1)


def period_of_day(ts: Column) -> Column:
    hour = F.hour(ts)
    expr = F.lit(None).cast("string")
    for name, last in reversed(PERIOD_LAST_HOUR.items()):
        expr = F.when(hour <= last, F.lit(name)).otherwise(expr)
    return expr
