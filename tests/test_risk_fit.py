"""The risk forest's fit carries only what the model needs, and its scoring walks each tree as the nodes say."""

import numpy as np
from pyspark.sql import functions as F

from ledgerline.operators import order
from ledgerline.operators.forest import flat_tree, grow_tree, path_sums
from ledgerline.operators.risk import RISK_FEATURES, risk_base, risk_features
from ledgerline.plans import risk as plan


def rows(spark):
    k = F.col("id")
    return spark.range(400).select(
        k.alias("txn_id"), F.timestamp_seconds(k * 977).cast("timestamp_ntz").alias("trans_date_trans_time"), F.concat(F.lit("M"), k % 9).alias("merchant"),
        F.lit("food").alias("category"), ((k * 37) % 101).cast("double").alias("amt"), F.lit("Town").alias("city"), F.lit("XY").alias("state"),
        (k % 7).alias("cc_num"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("long"), (k % 3).cast("double").alias("merch_lat"), F.lit(2.5).alias("merch_long"),
    )


def test_fit_stages_only_model_columns(spark, monkeypatch):
    staged = {}
    for module in (order, plan):
        real = module.stage
        monkeypatch.setattr(module, "stage", lambda df, name, real=real: staged.setdefault(name, real(df, name)))
    raw = rows(spark)
    plan.fit_risk_model(raw)
    assert set(staged["risk-features"].columns) == {"txn_id", *RISK_FEATURES}
    assert not {"city", "state", "category", "cust_lat", "merch_long"} & set(staged["ordered"].columns)
    every = risk_features(risk_base(raw)).select("txn_id", *RISK_FEATURES)
    assert every.count() == 400 and not every.exceptAll(staged["risk-features"].select(every.columns)).count()


def test_path_sums_equal_a_walk_of_each_row():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 4)), 1)
    x[7, 2] = np.nan
    grown = [grow_tree(np.round(rng.normal(size=(n, 4)), 1), np.random.default_rng(n), 6) for n in (1, 2, 64, 200)]
    want = np.zeros(len(x))
    for t in grown:
        for k, row in enumerate(x):
            node = t.iloc[0]
            while node["feature"] >= 0:
                node = t.iloc[int(node["left"] if row[int(node["feature"])] <= node["threshold"] else node["right"])]
            want[k] += node["path"]
    assert np.array_equal(path_sums(x, [flat_tree(t) for t in grown], 6), want)
    assert len(path_sums(x[:0], [flat_tree(t) for t in grown], 6)) == 0
