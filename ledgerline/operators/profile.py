"""Data profile before training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.quantiles import exact_quantiles


def profile_nulls(df: DataFrame, label: str = "category") -> DataFrame:
    """Row count, NULLs per column, labels and non-positive amounts, in one scan."""
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in df.columns]
    return df.agg(
        F.count("*").alias("rows"),
        *nulls,
        F.count_distinct(label).alias("labels"),
        F.count_if(F.col("amount") <= 0).alias("nonpositive_amounts"),
    )


def profile_duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in all columns.

    Rows are counted by a digest of 128 bits, so that only digests are shuffled; those that come more than once are then
    compared in full, as two different rows might share one.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    absent = F.concat(*(F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns))  # a hash passes NULL over
    digest = [F.xxhash64(F.lit(seed), absent, *columns).alias(f"_digest_{seed}") for seed in (1, 2)]
    names = ["_digest_1", "_digest_2"]
    several = df.select(*digest).groupBy(*names).agg(F.count("*").alias("_n")).where("_n > 1").select(*names)
    repeated = df.select("*", *digest).join(several, names, "left_semi")
    copies = repeated.groupBy(*names, *columns).agg(F.count("*").alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))


def profile_labels(df: DataFrame, label: str = "category", top: int = 20) -> DataFrame:
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "label").limit(top)


def profile_amount(df: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of ``amount``."""
    quartiles = exact_quantiles(df, "amount", [0.25, 0.5, 0.75])
    figures = df.agg(
        F.count("amount").alias("n"),
        F.avg("amount").alias("mean"),
        F.stddev_samp("amount").alias("std"),
        F.min("amount").alias("min"),
        F.max("amount").alias("max"),
    )
    q = quartiles.select("q").scalar()
    named = figures.withColumn("_q", q)
    names = {"q25": 0, "median": 1, "q75": 2}
    return named.select("*", *[F.get("_q", F.lit(i)).alias(name) for name, i in names.items()]).drop("_q")
