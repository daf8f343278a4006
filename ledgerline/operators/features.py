"""Per-row features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import times
from ledgerline.functions.numbers import bin_by_edges, bin_fixed, haversine_km, log_amount
from ledgerline.operators.cleaning import BATCH_NUMERIC, clean
from ledgerline.operators.quantiles import exact_quantiles

COORDINATES = ["cust_lat", "cust_long", "merch_lat", "merch_long"]
# Features the batch classifier derives, and columns that hold the answer.
BATCH_DERIVED = ["Hour", "DayOfWeek", "AbsAmount"]
LABEL_COLUMNS = ["is_fraud"]


def calendar_features(df: DataFrame) -> DataFrame:
    ts = F.col("timestamp")
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": times.day_of_week(ts),
            "day_of_month": F.dayofmonth(ts),
            "is_weekend": times.is_weekend(ts),
        }
    )


def quantile_edges(df: DataFrame, q: int) -> list[float]:
    """The ``q + 1`` exact quantile edges of ``amount``, to save with a model; none for an empty table."""
    row = exact_quantiles(df, "amount", [i / q for i in range(q + 1)]).first()
    return [] if row is None else [float(edge) for edge in row["q"]]


def amount_bin(df: DataFrame, bins: str = "quantile", q: int = 4, edges: list[float] | None = None) -> DataFrame:
    """``df`` with ``amount_bin``: by the quantiles of ``df``, by given edges, or by fixed ones."""
    amount = F.col("amount")
    if edges is None and bins == "fixed":
        return df.withColumn("amount_bin", bin_fixed(amount))
    if edges is None and bins != "quantile":
        raise ValueError(f"bins must be 'quantile' or 'fixed', not {bins!r}")
    return df.withColumn("amount_bin", bin_by_edges(amount, quantile_edges(df, q) if edges is None else edges))


def model_features(df: DataFrame, bins: str = "quantile", q: int = 4, edges: list[float] | None = None) -> DataFrame:
    """The numeric features of the category model on clean rows."""
    ts = F.col("timestamp")
    return amount_bin(df, bins, q, edges).withColumns(
        {"day_of_week": times.day_of_week(ts), "hour": F.hour(ts), "log_amount": log_amount(F.col("amount"))}
    )


def build_features(df: DataFrame, bins: str = "quantile", q: int = 4, edges: list[float] | None = None) -> DataFrame:
    """Clean rows with the features of the category model."""
    return model_features(clean(df), bins, q, edges)


def geo_distance(df: DataFrame) -> DataFrame:
    """``geo_missing`` and the customer-to-merchant distance, 0 where a coordinate is missing."""
    if not set(COORDINATES) <= set(df.columns):
        return df.withColumns({"geo_missing": F.lit(1), "geo_dist_km": F.lit(0.0)})
    known = F.lit(True)
    for name in COORDINATES:
        known = known & F.col(name).isNotNull()
    distance = haversine_km(*[F.col(c).cast("double") for c in COORDINATES])
    return df.withColumns(
        {"geo_missing": (~known).cast("int"), "geo_dist_km": F.coalesce(F.when(known, distance), F.lit(0.0))}
    )


def batch_features(df: DataFrame, expected: list[str] | None = None, use_labels: bool = False) -> DataFrame:
    """``df`` with the batch classifier's numeric features, NULL as 0.

    ``expected`` fixes the features: absent ones are 0 and others are left alone. Known label
    columns are no features unless ``use_labels`` says so.
    """
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    if not use_labels:
        numeric -= set(LABEL_COLUMNS)
    ts = F.col("timestamp")
    derived = {"Hour": F.hour(ts), "DayOfWeek": times.day_of_week(ts), "AbsAmount": F.abs(F.col("amount"))}
    wanted = expected or batch_feature_names(df, use_labels)

    def feature(name: str) -> Column:
        if name in derived:
            return derived[name]
        return F.col(f"`{name}`") if name in numeric else F.lit(0.0)

    zero = F.lit(0.0)
    return df.withColumns({n: F.coalesce(feature(n).cast("double"), zero) for n in wanted})


def batch_feature_names(df: DataFrame, use_labels: bool = False) -> list[str]:
    """Names of the features :func:`batch_features` would build from ``df``, in order."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    base = [n for n in BATCH_NUMERIC if n in numeric and (use_labels or n not in LABEL_COLUMNS)]
    return base + BATCH_DERIVED
