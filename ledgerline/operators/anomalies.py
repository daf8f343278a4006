"""Multi-dimensional anomalies of facts, with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import log_amount
from ledgerline.operators.features import calendar_features
from ledgerline.operators.forest import fit_isolation_forest
from ledgerline.operators.lookup import attach_group_stats
from ledgerline.operators.quantiles import exact_quantiles, quantile_value
from ledgerline.session import stage, with_row_key

# Features in model order, and the limits behind the reasons.
ANOMALY_FEATURES = [
    "hour", "day_of_week", "day_of_month", "is_weekend", "amount", "log_amount", "merchant_freq",
    "is_rare_merchant", "amount_vs_category_median", "daily_txn_count",
]
RARE_VISITS = 3
HIGH_AMOUNT_SHARE = 0.95
BUSY_DAY_SHARE = 0.90
EARLY_HOUR = 6
MIN_ROWS = 10


def anomaly_features(facts: DataFrame) -> DataFrame:
    """Facts with the ten features (nine without ``pred_category``); NULL features are 0."""
    merchants = facts.groupBy("merchant").agg(F.count("*").alias("n")).withColumn("merchant_freq", F.col("n"))
    rows = attach_group_stats(calendar_features(facts), merchants, ["merchant"], ["merchant_freq"])
    if "pred_category" in facts.columns:
        medians = exact_quantiles(facts, "amount", [0.5], by=["pred_category"]).select(
            "pred_category", "n", F.col("q")[0].alias("_median")
        )
        ratio = F.col("amount") / F.nullif(F.col("_median") + 1, F.lit(0.0))
        rows = (
            attach_group_stats(rows, medians, ["pred_category"], ["_median"])
            .withColumn("amount_vs_category_median", F.coalesce(ratio, F.lit(0.0)))
            .drop("_median")
        )
    day = F.to_date("timestamp")
    days = daily_counts(facts).select(F.col("day").alias("_day"), F.col("n").alias("daily_txn_count"))
    return (
        rows.withColumn("_date", day)
        .join(F.broadcast(days), F.col("_date") == F.col("_day"), "left")  # one row per calendar day
        .drop("_date", "_day")
        .withColumns(
            {
                "log_amount": F.coalesce(log_amount(F.col("amount")), F.lit(0.0)),
                "is_rare_merchant": (F.col("merchant_freq") <= RARE_VISITS).cast("int"),
            }
        )
    )


def daily_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))


def anomaly_reasons(features: DataFrame, facts: DataFrame) -> DataFrame:
    """``reasons``: why a row stands out, ``pattern_based`` when nothing simple applies.

    The limits come from ``facts``, the rows the features were built from.
    """
    high_amount = F.lit(quantile_value(facts, "amount", HIGH_AMOUNT_SHARE)).cast("double")
    # One row per calendar day, so the built-in percentile holds a small set.
    busy_day = F.lit(daily_counts(facts).agg(F.percentile("n", F.lit(BUSY_DAY_SHARE))).first()[0]).cast("double")
    hits = F.array_compact(
        F.array(
            F.when(F.col("is_rare_merchant") == 1, F.lit("rare_merchant")),
            F.when(F.col("amount") > high_amount, F.lit("high_amount")),
            F.when(F.col("daily_txn_count") > busy_day, F.lit("high_frequency_day")),
            F.when(F.col("hour") < EARLY_HOUR, F.lit("unusual_hour")),
        )
    )
    reasons = F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("pattern_based")))
    return features.withColumn("reasons", reasons)


def multi_dim_anomalies(
    facts: DataFrame, contamination: float = 0.05, trees: int = 100, top: int | None = 50, seed: int = 42
) -> DataFrame:
    """The most anomalous rows by an isolation forest fitted on the same facts, with reasons."""
    keyed = with_row_key(facts)
    features = stage(anomaly_reasons(anomaly_features(keyed), keyed), "anomaly-features")
    names = [f for f in ANOMALY_FEATURES if f in features.columns]
    shown = [c for c in ["txn_id", "timestamp", "merchant", "amount", "pred_category"] if c in facts.columns]
    if features.count() < MIN_ROWS:
        return features.limit(0).select(*shown, F.lit(0.0).alias("anomaly_score"), "reasons")
    _, flagged = fit_isolation_forest(features, names, trees, 256, contamination, seed)
    found = flagged.where("is_anomaly")
    if top is not None:
        found = found.orderBy(F.desc("anomaly_score"), "txn_id").limit(top)
    return found.select(*shown, "anomaly_score", "reasons")


def anomaly_daily(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy(F.to_date("timestamp").alias("date")).agg(F.count("*").alias("n")).orderBy("date")
