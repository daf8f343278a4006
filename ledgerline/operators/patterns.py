"""Behaviour patterns. Windows here run over calendar buckets only, never over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import times


def weekend_ratio(facts: DataFrame) -> DataFrame:
    weekend = times.is_weekend(F.col("timestamp")) == 1
    weekend_mean = F.avg(F.when(weekend, F.col("amount")))
    weekday_mean = F.avg(F.when(~weekend, F.col("amount")))
    return facts.agg((weekend_mean / (weekday_mean + 0.01)).alias("weekend_vs_weekday_ratio"))


def time_of_day(facts: DataFrame) -> DataFrame:
    """Sum and count for each of the four periods of the day, also for empty ones."""
    periods = F.array(
        *[F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("period")) for i, name in enumerate(times.PERIOD_LAST_HOUR)]
    )
    found = facts.groupBy(times.period_of_day(F.col("timestamp")).alias("period")).agg(
        F.sum("amount").alias("total"), F.count("*").alias("n")
    )
    all_periods = facts.sparkSession.range(1).select(F.inline(periods))
    return (
        all_periods.join(found, "period", "left")
        .select("ordinal", "period", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("ordinal")
    )


def spending_trend(facts: DataFrame, span: int = 3) -> DataFrame:
    """Mean of the last weeks against the first ones, in weeks since the first transaction."""
    micros = times.epoch_micros(F.col("timestamp"))
    first = facts.agg(F.min(micros).alias("first")).scalar()
    week = F.floor(times.whole_days(micros - first) / 7).cast("long")
    weekly = facts.groupBy(week.alias("week")).agg(F.sum("amount").alias("total"))
    ranked = weekly.withColumns(
        {
            "_from_start": F.row_number().over(W.orderBy("week")),
            "_from_end": F.row_number().over(W.orderBy(F.desc("week"))),
        }
    )
    summary = ranked.agg(
        F.count("*").alias("weeks"),
        F.avg(F.when(F.col("_from_start") <= span, F.col("total"))).alias("first_mean"),
        F.avg(F.when(F.col("_from_end") <= span, F.col("total"))).alias("last_mean"),
    )
    rising = F.when(F.col("last_mean") > F.col("first_mean"), "increasing").otherwise("decreasing")
    return summary.withColumn("spending_trend", F.when(F.col("weeks") > 2, rising).otherwise("stable"))


def merchant_entropy(facts: DataFrame) -> DataFrame:
    """Shannon entropy (natural log) of the transaction counts by merchant."""
    counts = facts.groupBy("merchant").agg(F.count("*").cast("double").alias("n"))
    total, weighted = F.sum("n"), F.sum(F.col("n") * F.ln("n"))
    return counts.agg((F.ln(total) - weighted / total).alias("merchant_diversity_score"))


def dow_average(facts: DataFrame) -> DataFrame:
    """Mean amount by day of the week, Monday first; days without rows are left out."""
    ts = F.col("timestamp")
    return (
        facts.groupBy(times.day_of_week(ts).alias("ordinal"), times.day_name(ts).alias("day"))
        .agg(F.avg("amount").alias("avg_amount"))
        .orderBy("ordinal")
    )
