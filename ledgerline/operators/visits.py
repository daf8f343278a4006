"""Gaps between visits to a merchant, without sorting a merchant's rows in one task.

Two visits on the same calendar day are less than a whole day apart, so their gap is 0. Rows are
therefore combined to one row per merchant and day first; only the gaps between days need an order.
A merchant then has at most as many rows as the calendar has days, however many visits it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.times import MICROS_PER_DAY, epoch_micros, whole_days


def merchant_days(facts: DataFrame) -> DataFrame:
    """Per merchant and day: visits, amount figures and whole days since the last visit before."""
    micros = epoch_micros(F.col("timestamp"))
    days = facts.groupBy("merchant", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("visits"),
        F.min(micros).alias("first_micros"),
        F.max(micros).alias("last_micros"),
        F.avg("amount").alias("mean"),
        F.var_pop("amount").alias("variance"),
    )
    last_day = F.lag("last_micros").over(W.partitionBy("merchant").orderBy("day"))
    return days.withColumn("gap", whole_days(F.col("first_micros") - last_day))


def _timestamp(micros: Column) -> Column:
    seconds = micros / F.lit(1_000_000)
    return (F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast(
        "timestamp_ntz"
    )


def recurring_charges(
    facts: DataFrame, min_count: int = 3, days: tuple[int, int] = (26, 33), max_cv: float = 0.2
) -> DataFrame:
    """Merchants charged about monthly with near-constant amounts, and the next expected time."""
    merchant = W.partitionBy("merchant")
    visits = F.sum("visits").over(merchant)
    # The mean over all rows comes first, so that the spread around it is a sum of squares.
    centred = merchant_days(facts).withColumn("centre", F.sum(F.col("visits") * F.col("mean")).over(merchant) / visits)
    squares = F.col("visits") * (F.col("variance") + F.pow(F.col("mean") - F.col("centre"), 2))
    # A day has one gap to the day before and, for its other visits, gaps of 0 days. Only the first
    # entry carries the figures of the day, so that one aggregation serves all of them.
    entries = F.array(
        F.struct(
            F.col("gap"),
            F.col("gap").isNotNull().cast("long").alias("times"),
            F.col("visits").alias("n"),
            squares.alias("squares"),
        ),
        F.struct(
            F.lit(0).cast("long").alias("gap"),
            (F.col("visits") - 1).alias("times"),
            F.lit(0).cast("long").alias("n"),
            F.lit(0.0).alias("squares"),
        ),
    )
    found = (
        centred.select("merchant", "centre", "last_micros", F.inline(entries))
        .groupBy("merchant")
        .agg(
            F.sum("n").alias("n"),
            F.max("centre").alias("_mean"),
            F.sum("squares").alias("_squares"),
            F.max("last_micros").alias("_last"),
            F.percentile("gap", F.lit(0.5), F.col("times")).alias("median_interval_days"),
        )
        .where(F.col("n") >= min_count)
        .withColumn("_std", F.sqrt(F.col("_squares") / F.nullif(F.col("n") - 1, F.lit(0))))
    )
    cv = F.col("_std") / F.nullif(F.col("_mean"), F.lit(0.0))
    next_micros = F.col("_last") + (F.col("median_interval_days") * MICROS_PER_DAY).cast("long")
    return (
        found.withColumn("amount_cv", cv)
        .where(F.col("median_interval_days").between(*days) & (F.col("amount_cv") < max_cv))
        .select(
            "merchant",
            "n",
            "median_interval_days",
            "amount_cv",
            _timestamp(F.col("_last")).alias("last_seen"),
            _timestamp(next_micros).alias("next_estimated"),
        )
        .orderBy("median_interval_days", "merchant")
    )


def merchants_due(facts: DataFrame, as_of: str, top: int = 10, limit: int = 5) -> DataFrame:
    """Of the most frequent merchants, those whose usual gap has almost passed at ``as_of``."""
    frequent = (
        facts.groupBy("merchant")
        .agg(F.count("*").alias("frequency"))
        .orderBy(F.desc("frequency"), "merchant")
        .limit(top)
    )
    visits = facts.join(F.broadcast(frequent), "merchant")  # at most `top` rows
    merchants = (
        merchant_days(visits.drop("frequency"))
        .groupBy("merchant")
        .agg(
            F.sum("visits").alias("n"),
            F.sum("gap").alias("_gaps"),
            F.max("last_micros").alias("_last"),
        )
        .where(F.col("n") >= 3)
    )
    now = epoch_micros(F.lit(as_of).cast("timestamp_ntz"))
    return (
        merchants.select(
            "merchant",
            "n",
            (F.col("_gaps") / (F.col("n") - 1)).alias("avg_interval_days"),
            whole_days(now - F.col("_last")).alias("days_since_last"),
        )
        .where(F.col("days_since_last") >= F.col("avg_interval_days") * 0.8)
        .orderBy(F.desc("n"), "merchant")
        .limit(limit)
        .drop("n")
    )
