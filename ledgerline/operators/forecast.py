"""Short forecasts from monthly totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.times import month_label

MIN_ROWS = 30
MIN_MONTHS = 3


def _monthly(facts: DataFrame) -> DataFrame:
    """Months that have data, numbered from the latest."""
    months = facts.groupBy(month_label(F.col("timestamp")).alias("month")).agg(
        F.sum("amount").alias("total"), F.count("*").alias("n")
    )
    return months.withColumn("age", F.row_number().over(W.orderBy(F.desc("month"))))


def _projection(facts: DataFrame) -> DataFrame:
    """One row, or none when there is too little history."""
    figures = _monthly(facts).agg(
        F.avg(F.when(F.col("age") <= 3, F.col("total"))).alias("projected_next_month"),
        F.max(F.when(F.col("age") == 1, F.col("total"))).alias("current_month"),
        F.count("*").alias("_months"),
        F.sum("n").alias("_rows"),
    )
    enough = (F.col("_months") >= MIN_MONTHS) & (F.col("_rows") >= MIN_ROWS)
    return figures.where(enough).select("projected_next_month", "current_month")


def projected_next_month(facts: DataFrame) -> DataFrame:
    return _projection(facts).select("projected_next_month")


def projection_change(facts: DataFrame) -> DataFrame:
    """Projection, latest month and the change in percent (0 when the latest month is not positive)."""
    projected, current = F.col("projected_next_month"), F.col("current_month")
    change = F.when(current > 0, (projected - current) / current * 100).otherwise(F.lit(0.0))
    return _projection(facts).withColumn("change_pct", change)


def growing_categories(facts: DataFrame) -> DataFrame:
    """Categories whose latest month is above their third-latest one."""
    monthly = facts.groupBy(
        F.col("pred_category").alias("category"), month_label(F.col("timestamp")).alias("month")
    ).agg(F.sum("amount").alias("total"))
    latest_first = W.partitionBy("category").orderBy(F.desc("month"))
    by_category = (
        monthly.withColumn("age", F.row_number().over(latest_first))
        .where(F.col("age") <= 3)
        .groupBy("category")
        .agg(
            F.max(F.when(F.col("age") == 1, F.col("total"))).alias("latest"),
            F.max(F.when(F.col("age") == 3, F.col("total"))).alias("third_latest"),
        )
    )
    enough = _projection(facts).agg((F.count("*") > 0).alias("enough")).scalar()
    return by_category.where((F.col("latest") > F.col("third_latest")) & enough).select("category")
