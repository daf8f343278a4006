"""Isolation forest by its properties."""

import datetime as dt
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerline.operators import anomalies, forest
from ledgerline.operators.facts import make_facts

FEATURES = ["x", "y", "constant"]


def points(n=3000, planted=6, seed=1):
    rng = np.random.default_rng(seed)
    data = pd.DataFrame({"txn_id": np.arange(n), "x": rng.normal(size=n), "y": rng.normal(size=n), "constant": 1.0})
    data.loc[: planted - 1, ["x", "y"]] = 25.0 + rng.normal(size=(planted, 2))
    return data


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(points()).repartition(5)
    return forest.fit_isolation_forest(df, FEATURES, trees=50, sample_size=128, contamination=0.05)


def test_scores_flags_and_planted_points(fitted):
    _, scored = fitted
    found = scored.toPandas()
    assert found.anomaly_score.between(0, 1, inclusive="right").all()
    assert abs(found.is_anomaly.sum() - 150) <= 1
    assert set(found.nlargest(30, "anomaly_score").txn_id) >= set(range(6))


def test_same_seed_same_model_whatever_the_partitions(spark, fitted):
    model, _ = fitted
    again, _ = forest.fit_isolation_forest(
        spark.createDataFrame(points()).repartition(2), FEATURES, trees=50, sample_size=128, contamination=0.05
    )
    left = model.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    right = again.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(left, right)
    assert model.offset == pytest.approx(again.offset, abs=1e-12)


def test_save_and_load(spark, fitted, tmp_path):
    model, _ = fitted
    model.save(spark, str(tmp_path / "forest"))
    loaded = forest.IsolationForestModel.load(spark, str(tmp_path / "forest"))
    df = spark.createDataFrame(points(200))
    scores = [m.transform(df).orderBy("txn_id").toPandas() for m in (model, loaded)]
    pd.testing.assert_frame_equal(*scores)


@pytest.mark.parametrize("total, trees, size", [(60, 10, 60), (1000, 20, 64), (40_000, 20, 64)])
def test_each_tree_gets_its_own_full_sample(spark, total, trees, size):
    df = spark.range(total).select(F.col("id").alias("txn_id"), F.col("id").cast("double").alias("x"))
    samples = forest.tree_samples(df, ["x"], trees, size, total, 42, "txn_id").toPandas()
    by_tree = samples.groupby("tree").x
    assert len(by_tree) == trees
    assert (by_tree.size() == size).all() and (by_tree.nunique() == size).all()


def test_mean_path():
    np.testing.assert_allclose(forest.mean_path(np.array([1, 2, 256])), [0, 1, 10.2448], atol=1e-4)


def test_anomalies_of_facts(spark):
    start = dt.datetime(2024, 1, 1, 12)
    rows = [(i, start + dt.timedelta(hours=5 * i), f"m{i % 4}", 10.0 + i % 7, "c") for i in range(300)]
    rows.append((300, dt.datetime(2024, 1, 6, 3), "odd", 5000.0, "c"))
    df = spark.createDataFrame(rows, "txn_id long, timestamp timestamp_ntz, merchant string, amount double, pred_category string")
    facts = make_facts(df)
    found = anomalies.multi_dim_anomalies(facts).collect()
    assert len(found) <= 16 and found[0].txn_id == 300
    assert found[0].reasons == ["rare_merchant", "high_amount", "high_frequency_day", "unusual_hour"]
    assert anomalies.multi_dim_anomalies(facts.limit(9)).count() == 0


def test_workers_need_no_copy_of_the_package(tmp_path):
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(forest.grow_tree))
    code = "import pickle, numpy as np; f = pickle.load(open('f.pkl', 'rb')); print(len(f(np.eye(3), np.random.default_rng(1), 2)))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) >= 3
