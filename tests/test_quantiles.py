"""Exact quantiles over one and many ranges, look-ups and samples on their large-table paths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import sampling
from ledgerline.operators.lookup import attach_group_stats
from ledgerline.operators.quantiles import exact_quantiles, rank_values

SHARES = [0.0, 0.05, 0.25, 0.5, 0.95, 0.99, 1.0]


def values(kind, n=6000, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "continuous":
        return rng.normal(size=n)
    if kind == "ties":  # a third of all rows share one value
        return np.where(rng.random(n) < 0.34, 9.99, np.round(rng.gamma(1, 30, n), 0))
    return np.full(n, 5.0)


@pytest.mark.parametrize("kind", ["continuous", "ties", "constant"])
@pytest.mark.parametrize("parts", [1, 40, None])
def test_whole_table(spark, kind, parts):
    v = values(kind)
    df = spark.createDataFrame(pd.DataFrame({"v": v})).repartition(7)
    row = exact_quantiles(df, "v", SHARES, parts=parts).first()
    assert row.n == len(v)
    np.testing.assert_allclose(row.q, np.quantile(v, SHARES), rtol=1e-12)


def test_by_group_with_nulls_and_a_hot_group(spark):
    v = values("ties")
    group = np.where(np.arange(len(v)) % 3 > 0, "hot", np.char.add("g", (np.arange(len(v)) % 50).astype(str)))
    data = pd.DataFrame({"g": group, "v": v})
    data.loc[::11, "v"] = None
    df = spark.createDataFrame(data).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    found = exact_quantiles(df, "v", [0.5, 0.9], by=["g"], parts=30).toPandas().set_index("g")
    for name, part in data.dropna().groupby("g"):
        np.testing.assert_allclose(found.loc[name, "q"], np.quantile(part.v, [0.5, 0.9]), rtol=1e-12)


def test_empty_table_has_no_quantile(spark):
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranges_hold_no_more_rows_in_a_larger_table(spark, by):
    largest = []
    for n, parts in ((20_000, 4), (160_000, 32)):
        df = spark.range(n).select(F.xxhash64("id").alias("v"), F.when(F.col("id") % 3 > 0, "hot").alias("g"))
        sizes = rank_values(df, "v", by, parts).groupBy("_part").count().toPandas()
        assert sizes["count"].sum() == n
        largest.append(sizes["count"].max())
    assert max(largest) < 10_000


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None)], "g string, v double")
    found = {r.g: (r.n, r.q) for r in exact_quantiles(df, "v", [0.5], by=["g"], parts=3).collect()}
    assert found == {None: (2, [2.0]), "a": (1, [5.0])}


@pytest.mark.parametrize("broadcast_groups", [0, 1_000])
def test_lookup_is_the_same_with_and_without_broadcast(spark, broadcast_groups):
    df = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k")
    )
    stats = df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    found = attach_group_stats(df, stats, ["k"], ["top"], broadcast_groups=broadcast_groups).toPandas()
    assert len(found) == 6000 and found.top.notna().all()
    assert (found[found.k == "hot"].top == 5997).all()
    assert (found[found.k.isna()].top == found[found.k.isna()].id.max()).all()


def test_sample_has_exact_quotas_and_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select(
        F.col("id").alias("txn_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 10 == 1, "b").otherwise("c").alias("category")
    )
    drawn = [
        {r.txn_id for r in sampling.stratified_sample(part, "category", 1001).collect()}
        for part in (df.repartition(3), df.repartition(11, "category"))
    ]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 1001
    split = sampling.stratified_split(df, "category").groupBy("category", "split").count().toPandas()
    assert split[split.split == "test"]["count"].sum() == 1000
    shares = split.pivot(index="category", columns="split", values="count")
    np.testing.assert_allclose(shares.test / shares.sum(axis=1), 0.2, atol=1e-3)
