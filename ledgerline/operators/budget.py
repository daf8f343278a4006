"""Budgets against actual spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.insights import category_spend

TOTAL = "TOTAL"


def in_month(facts: DataFrame, month: str | None = None) -> DataFrame:
    """Rows of one month; the latest one when none is named."""
    wanted = F.lit(month) if month else facts.agg(F.max("month").alias("month")).scalar()
    return facts.where(F.col("month") == wanted)


def budget_default_categories(facts: DataFrame, month: str | None = None, top: int = 5) -> DataFrame:
    return category_spend(in_month(facts, month), top)


def budget_status(pct_used: Column) -> Column:
    share = F.least(pct_used / 100, F.lit(1.0))
    return F.when(share < 0.8, "green").when(share < 1.0, "orange").otherwise("red")


def budget_vs_actual(facts: DataFrame, budgets: DataFrame, month: str | None = None) -> DataFrame:
    """Budget, actual, variance and percent used by category, and a TOTAL row (without status)."""
    actuals = category_spend(in_month(facts, month), top=None)
    lines = budgets.join(actuals, "category", "left").select(
        "category", "budget", F.coalesce("total_spend", F.lit(0.0)).alias("actual")
    )
    sums = lines.rollup("category").agg(
        F.grouping("category").alias("_total"), F.sum("budget").alias("budget"), F.sum("actual").alias("actual")
    )
    used = F.when(F.col("budget") > 0, F.col("actual") / F.col("budget") * 100).otherwise(F.lit(0.0))
    is_total = F.col("_total") == 1
    return sums.where(~is_total | F.col("budget").isNotNull()).select(
        F.when(is_total, F.lit(TOTAL)).otherwise(F.col("category")).alias("category"),
        "budget",
        "actual",
        (F.col("budget") - F.col("actual")).alias("variance"),
        used.alias("pct_used"),
        F.when(~is_total, budget_status(used)).alias("status"),
    )
