"""Evaluation of predictions. Everything derives from one small table of label pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """Count for each pair of true labels, 0 where none, in label order."""
    pairs = _pairs(df, true, pred)
    labels = pairs.agg(F.sort_array(F.collect_set("true")).alias("labels"))
    grid = labels.select(F.explode("labels").alias("true"), "labels").select("true", F.explode("labels").alias("pred"))
    return (
        grid.join(pairs, ["true", "pred"], "left")
        .select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("true", "pred")
    )


def class_report(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support by class; 0 where a quotient has no base."""
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("hits")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )
    sums = (
        _pairs(df, true, pred)
        .select(F.inline(sides))
        .groupBy("label")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )

    def share(over) -> Column:
        return F.when(over > 0, F.col("hits") / over).otherwise(F.lit(0.0))

    support, predicted = F.col("support"), F.col("predicted")
    return sums.select(
        F.col("label").alias("class"),
        share(predicted).alias("precision"),
        share(support).alias("recall"),
        F.when(support + predicted > 0, 2 * F.col("hits") / (support + predicted)).otherwise(F.lit(0.0)).alias("f1"),
        "support",
    )


def f1_scores(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """Macro and support-weighted F1 as one row, ready for a JSON sink."""
    weighted = F.sum(F.col("f1") * F.col("support")) / F.sum("support")
    return class_report(df, true, pred).agg(F.avg("f1").alias("macro_f1"), weighted.alias("weighted_f1"))


def prediction_sample(df: DataFrame, true: str = "true", pred: str = "pred", n: int = 200) -> DataFrame:
    """The first ``n`` rows by row key, for inspection."""
    return df.orderBy("txn_id").limit(n).select(
        "txn_id", "merchant", "amount", "timestamp", F.col(true).alias("true"), F.col(pred).alias("pred")
    )
