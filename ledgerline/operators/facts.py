"""The facts table all insight operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import times
from ledgerline.operators.cleaning import drop_incomplete, parse_columns


def category_fallback(df: DataFrame) -> DataFrame:
    """``pred_category`` without a model: the given category as text, else ``uncategorized``."""
    given = F.col("category").cast("string") if "category" in df.columns else F.lit(None).cast("string")
    return df.withColumn("pred_category", F.coalesce(given, F.lit("uncategorized")))


def make_facts(df: DataFrame) -> DataFrame:
    """Complete rows with ``date``, ``week`` and ``month``. Persist the result to use it often."""
    ts = F.col("timestamp")
    return drop_incomplete(parse_columns(df)).withColumns(
        {"date": F.to_date(ts), "week": times.week_label(ts), "month": times.month_label(ts)}
    )
