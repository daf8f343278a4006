"""Spending summaries. All aggregates combine on the map side, so a hot key costs one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.times import epoch_micros, whole_days
from ledgerline.operators.lookup import attach_group_stats


def kpi_summary(facts: DataFrame, approximate: bool = False) -> DataFrame:
    merchants = F.approx_count_distinct("merchant") if approximate else F.count_distinct("merchant")
    micros = epoch_micros(F.col("timestamp"))
    return facts.agg(
        F.sum("amount").alias("total_spend"),
        F.count("*").alias("transactions"),
        F.avg("amount").alias("avg_ticket"),
        merchants.alias("unique_merchants"),
        whole_days(F.max(micros) - F.min(micros)).alias("days_tracked"),
    )


def category_accuracy(df: DataFrame, predicted: str = "pred_category", label: str = "category") -> DataFrame:
    agree = F.coalesce(F.col(predicted) == F.col(label), F.lit(False))
    return df.agg(F.avg(agree.cast("int")).alias("agreement"))


def _top(df: DataFrame, measure: str, tie: str, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(F.desc(measure), F.asc(tie)).limit(n)


def category_spend(facts: DataFrame, top: int | None = 10) -> DataFrame:
    totals = facts.groupBy(F.col("pred_category").alias("category")).agg(F.sum("amount").alias("total_spend"))
    return _top(totals, "total_spend", "category", top)


def category_counts(facts: DataFrame, top: int | None = 10) -> DataFrame:
    counts = facts.groupBy(F.col("pred_category").alias("category")).agg(F.count("*").alias("n"))
    return _top(counts, "n", "category", top)


def top_merchants(facts: DataFrame, top: int = 15, category: str | None = None) -> DataFrame:
    if category is not None:
        facts = facts.where(F.col("pred_category") == category)
    totals = facts.groupBy("merchant").agg(
        F.sum("amount").alias("total_spend"), F.count("*").alias("transactions")
    )
    return _top(totals, "total_spend", "merchant", top)


def values_present(facts: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column such as ``month``, in order."""
    return facts.select(column).distinct().orderBy(column)


# Start of the bucket, its label (a week is named by its Sunday, a month by its last day), its length.
_BUCKETS = {
    "day": (lambda d: d, lambda d: d, "interval 1 day"),
    "week": (lambda d: F.trunc(d, "week").cast("date"), lambda d: F.date_add(d, 6), "interval 7 day"),
    "month": (lambda d: F.trunc(d, "month").cast("date"), F.last_day, "interval 1 month"),
}


def spend_series(facts: DataFrame, every: str = "week") -> DataFrame:
    """Sum, count and mean per day, week or month; empty buckets have sum 0, count 0, mean NULL."""
    start, label, step = _BUCKETS[every]
    found = facts.groupBy(start(F.to_date("timestamp")).alias("start")).agg(
        F.sum("amount").alias("total"), F.count("*").alias("n"), F.avg("amount").alias("mean")
    )
    span = found.agg(F.min("start").alias("first"), F.max("start").alias("last"))
    calendar = span.where(F.col("first").isNotNull()).select(
        F.explode(F.sequence("first", "last", F.expr(step))).alias("start")
    )
    return calendar.join(found, "start", "left").select(
        label(F.col("start")).alias("bucket"),
        F.coalesce("total", F.lit(0.0)).alias("total"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "mean",
    )


def high_spend_z(facts: DataFrame, top_n: int | None = 5) -> DataFrame:
    """Rows with the highest amount against their category, in sample standard deviations.

    Categories with one row or no spread are left out.
    """
    stats = facts.groupBy("pred_category").agg(
        F.count("*").alias("n"), F.avg("amount").alias("_mean"), F.stddev_samp("amount").alias("_std")
    )
    z = (F.col("amount") - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0))
    scored = (
        attach_group_stats(facts, stats, ["pred_category"], ["_mean", "_std"])
        .withColumn("z", z)
        .where(F.col("z").isNotNull())
        .drop("_mean", "_std")
    )
    if top_n is None:
        return scored
    return scored.orderBy(F.desc("z"), *row_order(scored)).limit(top_n)


def row_order(df: DataFrame) -> list[Column]:
    """Tie-break columns: the row key when there is one, else time and merchant."""
    names = [c for c in ("txn_id", "timestamp", "merchant", "amount") if c in df.columns]
    return [F.asc(names[0])] if names[:1] == ["txn_id"] else [F.asc(c) for c in names]
