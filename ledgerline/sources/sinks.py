"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.times import month_label


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header; lists are joined by comma."""
    columns = [
        F.array_join(f.name, ",").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
        for f in df.schema
    ]
    df.select(*columns).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_by_month(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by month, so that a month filter reads only its own files.

    Rows are rebalanced by month first: few files per month, and a large month is split.
    """
    (
        df.withColumn("month", month_label(F.col("timestamp")))
        .hint("rebalance", "month")
        .write.mode(mode)
        .partitionBy("month")
        .parquet(path)
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
