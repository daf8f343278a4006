"""Cleaning of aligned transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.values import as_number, as_timestamp, normal_text

TEXT_COLUMNS = ["merchant", "city", "state"]
# Numeric columns a batch file may hold.
BATCH_NUMERIC = [
    "lat", "long", "city_pop", "unix_time", "merch_lat", "merch_long",
    "Unnamed: 0", "cc_num", "zip", "is_fraud", "merch_zipcode",
]
RISK_NUMBERS = ["amount", "unix_time", "cust_lat", "cust_long", "merch_lat", "merch_long"]


def parse_columns(df: DataFrame, currency: bool = False, day_first: bool = False, formats: tuple[str, ...] = ()) -> DataFrame:
    """``timestamp`` and ``amount`` typed, bad or infinite values NULL; no row is dropped."""
    return df.withColumns(
        {
            "timestamp": as_timestamp(df, "timestamp", day_first, formats),
            "amount": as_number(df, "amount", currency),
        }
    )


def drop_incomplete(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    return df.dropna(subset=["timestamp", "amount", *also])


def clean(df: DataFrame, currency: bool = False, day_first: bool = False, formats: tuple[str, ...] = ()) -> DataFrame:
    """Typed time and amount, normal merchant text (the given text stays in ``merchant_raw``)."""
    typed = parse_columns(df, currency, day_first, formats)
    if "merchant_raw" not in typed.columns:
        typed = typed.withColumn("merchant_raw", F.col("merchant"))
    return drop_incomplete(typed.withColumn("merchant", normal_text(F.col("merchant"))))


def drop_report(df: DataFrame, currency: bool = False, day_first: bool = False) -> DataFrame:
    """Rows in, rows kept and rows dropped by :func:`clean`, in one scan."""
    typed = parse_columns(df, currency, day_first)
    missing = F.col("timestamp").isNull() | F.col("amount").isNull()
    counts = typed.agg(F.count("*").alias("rows_in"), F.count_if(missing).alias("dropped"))
    return counts.select("rows_in", (F.col("rows_in") - F.col("dropped")).alias("kept"), "dropped")


def clean_risk(df: DataFrame) -> DataFrame:
    """As :func:`clean` for the risk columns: coordinates typed, and all text columns normal."""
    changes = {"timestamp": as_timestamp(df, "timestamp")}
    changes |= {c: as_number(df, c) for c in RISK_NUMBERS if c in df.columns}
    changes |= {c: normal_text(F.col(c)) for c in TEXT_COLUMNS if c in df.columns}
    return drop_incomplete(df.withColumns(changes))


def clean_batch(df: DataFrame) -> DataFrame:
    """Batch-file cleaning: day-first times, currency amounts, ``Unknown`` for no merchant."""
    typed = parse_columns(df, currency=True, day_first=True)
    changes = {"merchant": F.coalesce(F.col("merchant").cast("string"), F.lit("Unknown"))}
    changes |= {c: as_number(typed, c) for c in BATCH_NUMERIC if c in typed.columns}
    return drop_incomplete(typed.withColumns(changes))
