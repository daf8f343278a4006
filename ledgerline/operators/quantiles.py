"""Exact quantiles without holding all values of a group in one task.

The built-in ``percentile`` keeps every distinct value of a group in memory. Here equal values are counted first, so that a
value which a third of all rows share is one row. The counts are cut into ranges of group and value, and a running sum
within each range is put on top of the rows in the ranges before it. No task holds more than one range, whatever a group's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.session import stage


def rank_values(df: DataFrame, value: str, by: list[str], parts: int | None = None) -> DataFrame:
    """The distinct values of each group, with their ranks.

    ``value``, ``upto`` (rows of the group up to and with this value), ``n`` (rows of the group) and ``_part`` (the range).
    NULL values are left out, a NULL group is a group. The counts are staged when this is called. ``parts`` is the number
    of ranges, by default that of shuffle partitions.
    """
    values = df.select(*by, F.col(value).alias("value")).where(F.col("value").isNotNull())
    counts = values.groupBy(*by, "value").agg(F.count("*").alias("_rows"))
    # The rows are unique by these keys, so that ties cannot swell a range.
    keys = [*by, "value"]
    ranged = counts.repartitionByRange(parts, *keys) if parts else counts.repartitionByRange(*keys)
    ranged = stage(ranged.withColumn("_part", F.spark_partition_id()), "value-counts")

    # One row per range, and one more for each group that starts inside a range.
    before = W.partitionBy(*by).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy(*by, F.col("_part").alias("_at")).agg(F.sum("_rows").alias("_size"))
    starts = sizes.select(
        *[F.col(k).alias(f"_{k}") for k in by],
        "_at",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.sum("_size").over(W.partitionBy(*by)).alias("n"),
    )
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by], F.col("_part") == F.col("_at"))
    within = W.partitionBy("_part", *by).orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    return (
        ranged.withColumn("_upto", F.sum("_rows").over(within))
        .join(starts, same)
        .select(*by, "value", (F.col("_start") + F.col("_upto")).alias("upto"), "n", "_part")
    )


def value_at(rank: Column) -> Column:
    """Aggregate over :func:`rank_values`: the value at a 0-based rank."""
    return F.min_by("value", F.when(F.col("upto") > rank, F.col("upto")))


def exact_quantiles(
    df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, parts: int | None = None
) -> DataFrame:
    """One row per group with ``n`` and ``q`` (array, linear interpolation, in the order of ``shares``).

    NULL values are left out. Without ``by`` there is one row, or none for an empty table.
    """
    by = by or []
    wanted, fractions = [], []
    for i, p in enumerate(shares):
        exact = (F.col("n") - 1) * F.lit(float(p))
        low = F.floor(exact)
        wanted += [value_at(low).alias(f"_low{i}"), value_at(F.ceil(exact)).alias(f"_high{i}")]
        fractions.append(F.max(exact - low).alias(f"_part{i}"))
    picked = (
        rank_values(df, value, by, parts)
        .groupBy(*by)
        .agg(F.max("n").alias("n"), *wanted, *fractions)
        .where(F.col("n").isNotNull())
    )
    quantiles = [
        F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}") for i in range(len(shares))
    ]
    return picked.select(*by, "n", F.array(*quantiles).alias("q"))


def quantile_value(df: DataFrame, value: str, share: float) -> float | None:
    """One quantile of the whole table, fetched; None when there is no value."""
    row = exact_quantiles(df, value, [share]).first()
    return None if row is None else float(row["q"][0])
