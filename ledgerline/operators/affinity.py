"""Spend of the most frequent merchants by the most frequent categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _most_frequent(facts: DataFrame, column: str, n: int) -> DataFrame:
    counts = facts.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(n).select(column)


def merchant_category_affinity(
    facts: DataFrame, categories: list[str] | None = None, top_categories: int = 5, top_merchants: int = 10
) -> DataFrame:
    """One row per merchant, one column per category, missing cells 0.

    The columns must be known when the plan is built, so unless ``categories`` names them the
    ``top_categories`` labels are fetched first; nothing larger reaches the driver. NULL is no label and no merchant.
    """
    if categories is None:
        categories = [row[0] for row in _most_frequent(facts, "pred_category", top_categories).collect()]
    merchants = _most_frequent(facts, "merchant", top_merchants)
    chosen = facts.where(F.col("pred_category").isin(categories)).join(F.broadcast(merchants), "merchant", "left_semi")
    return chosen.groupBy("merchant").pivot("pred_category", sorted(categories)).agg(F.sum("amount")).na.fill(0.0)
