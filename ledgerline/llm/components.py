"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import stage


def _neighbours_to_min(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step: every node's neighbours are tied to the smallest node among them and the node itself."""
    if both_ways:
        pairs = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).union(edges.select("v", "u"))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("w"))
    least = pairs.groupBy("n").agg(F.least(F.min("w"), F.first("n")).alias("m"))
    tied = pairs.join(least, "n")
    if both_ways:
        return tied.where(F.col("w") > F.col("n")).select(F.col("w").alias("u"), F.col("m").alias("v"))
    return tied.select(F.col("w").alias("u"), F.col("m").alias("v")).union(least.select("n", "m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node of its component.

    Large-star and small-star steps alternate until the stars no longer change; a few rounds for the near-star graphs of
    near-duplicates, logarithmically many in general. Every round is staged, so a lost executor costs no lineage. A hub
    is aggregated on the map side; its rows meet it in a plain join that adaptive execution can split.
    """
    edges = edges.where("u <> v").select("u", "v").distinct()
    before = None
    while True:
        large = _neighbours_to_min(edges, both_ways=True).where("u <> v").distinct()
        edges = stage(_neighbours_to_min(large, both_ways=False).where("u <> v").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
