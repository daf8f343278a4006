"""Stratified samples of exact size, and class weights.

Rows are drawn by the order of a hash of their key. The hash at which a label's quota is full is
found by exact rank selection, so no label's rows are sorted or ranked in one task.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.lookup import attach_group_stats
from ledgerline.operators.quantiles import rank_values, value_at


def label_quotas(df: DataFrame, label: str, size: int) -> DataFrame:
    """Rows to draw per label: proportional, rounded down, the rest by largest remainder."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = W.partitionBy()
    # Wide decimals: the product of two row counts does not fit a long at scale.
    product = F.lit(size).cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    shares = (
        counts.withColumn("_total", F.sum("n").over(everything))
        .withColumn("_product", product)
        .selectExpr("*", "_product div _total as _base", "_product % _total as _remainder")
    )
    left = F.lit(size) - F.sum("_base").over(everything)
    rank = F.row_number().over(W.orderBy(F.desc("_remainder"), label))
    return shares.select(label, "n", (F.col("_base") + F.when(rank <= left, 1).otherwise(0)).alias("quota"))


def _mark(df: DataFrame, label: str, size: int, seed: int, key: str) -> DataFrame:
    """``_drawn``: whether the row is among its label's quota."""
    hashed = df.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed)))
    quotas = label_quotas(df, label, size)
    ranks = rank_values(hashed, "_hash", [label])
    cuts = (
        attach_group_stats(ranks, quotas, [label], ["quota"])
        .where(F.col("quota") > 0)
        .groupBy(label)
        .agg(F.max("n").alias("n"), value_at(F.col("quota") - 1).cast("long").alias("_cut"))
    )
    marked = attach_group_stats(hashed, cuts, [label], ["_cut"])
    drawn = F.coalesce(F.col("_hash") <= F.col("_cut"), F.lit(False))
    return marked.withColumn("_drawn", drawn).drop("_hash", "_cut")


def stratified_sample(df: DataFrame, label: str, size: int, seed: int = 42, key: str = "txn_id") -> DataFrame:
    """``size`` rows (all, if fewer) with the label shares of ``df``."""
    total = df.count()
    if size >= total:
        return df
    return _mark(df, label, size, seed, key).where("_drawn").drop("_drawn")


def stratified_split(
    df: DataFrame, label: str, test_share: float = 0.2, seed: int = 42, key: str = "txn_id"
) -> DataFrame:
    """``df`` with ``split``: ``test`` for a stratified share of the rows, else ``train``."""
    total = df.count()
    marked = _mark(df, label, ceil(test_share * total), seed, key)
    split = F.when(F.col("_drawn"), F.lit("test")).otherwise(F.lit("train"))
    return marked.withColumn("split", split).drop("_drawn")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per label: rows / (labels * rows of the label)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    everything = W.partitionBy()
    weight = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))
