"""Attaching per-group figures to rows when one group may hold a third of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import stage

BROADCAST_GROUPS = 200_000
HOT_SHARE = 1_000  # a group is hot when it holds more than 1/HOT_SHARE of all rows


def attach_group_stats(
    rows: DataFrame,
    stats: DataFrame,
    by: list[str],
    columns: list[str],
    weight: str = "n",
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """Left join of ``stats`` (one row per group, ``weight`` = its row count) to ``rows``.

    The group table is staged and counted. Up to ``broadcast_groups`` groups it is broadcast, so that
    ``rows`` is not shuffled. Beyond that only hot groups are broadcast: fewer than HOT_SHARE groups
    can hold more than 1/HOT_SHARE of the rows each. The others are joined by key, and none of them
    is large enough to hold a task up; ``rows`` is then read once for each part. A NULL key matches
    the group of NULL.
    """
    figures = stage(
        stats.select(*[F.col(k).alias(f"_{k}") for k in by], F.col(weight).alias("_n"), F.struct(*columns).alias("_stats")),
        "group-stats",
    )
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by])
    if figures.count() <= broadcast_groups:
        joined = rows.join(F.broadcast(figures), same, "left")
    else:
        threshold = figures.agg(F.sum("_n").alias("total")).scalar() / HOT_SHARE
        hot = F.broadcast(figures.where(F.col("_n") > threshold))
        cold = figures.where(F.col("_n") <= threshold)
        joined = rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(cold, same, "left"))
    kept = [c for c in rows.columns if c not in columns]
    return joined.select(*kept, *[F.col("_stats")[c].alias(c) for c in columns])
