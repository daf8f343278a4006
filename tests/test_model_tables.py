"""Models as tables against the models themselves, the optimality proof, and the forest as a pipeline stage."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ledgerline.operators import batch, categorizer, forest, trees
from ledgerline.operators.forest_stage import FORMAT, IsolationForestStage

LABELS = ["food", "fuel", "rent"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 400
    label = rng.integers(0, 3, n)
    rows = pd.DataFrame(
        {
            "txn_id": np.arange(n),
            "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 10**7, n), unit="s"),
            "amount": label * 20 + rng.normal(0, 12, n),
            "lat": np.where(label == 1, 5, 0) + rng.normal(0, 3, n),
            "flat": 1.0,
            "merchant": [" ".join(rng.choice([f"{LABELS[k]} shop", "the big one", "corner", "x y zz"], 2)) for k in label],
            "category": [LABELS[k] for k in label],
        }
    )
    return spark.createDataFrame(rows).repartition(3)


def test_forest_in_joins_equals_the_udf(spark, table):
    model, scored = forest.fit_isolation_forest(table, ["amount", "lat", "flat"], trees=20, sample_size=64)
    rows = table.drop("lat")  # a feature that is absent counts as 0 both ways
    for df in (table, rows, table.limit(0)):
        a = {r.txn_id: r.anomaly_score for r in model.score(df).collect()}
        b = {r.txn_id: r.anomaly_score for r in model.score_in_joins(df).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


@pytest.mark.parametrize("kind", ["rf", "mlp"])
def test_tables_predict_as_the_model(spark, table, kind):
    model = batch.fit_batch_classifier(table, kind=kind, trees=15, max_depth=6, hidden=(7,), max_iterations=40)
    own = {r.txn_id: r.predicted_category for r in batch.classify_by_tables(table, model).collect()}
    assert own == {r.txn_id: r.predicted_category for r in batch.batch_classify(table, model).collect()}
    assert len(set(own.values())) == 3


@pytest.mark.parametrize("kind", ["rf", "mlp"])
def test_fits_read_rows_in_as_many_tasks_as_cores(spark, table, kind, monkeypatch):
    seen, fit = [], batch.Pipeline.fit
    monkeypatch.setattr(batch.Pipeline, "fit", lambda self, rows: (seen.append(rows.rdd.getNumPartitions()), fit(self, rows))[1])
    batch.fit_batch_classifier(table.coalesce(1), kind=kind, trees=2, max_depth=2, hidden=(2,), max_iterations=2)
    assert seen == [spark.sparkContext.defaultParallelism] and seen[0] > 1


def test_too_many_nodes_are_refused(spark, monkeypatch):
    nodes = spark.createDataFrame([(0, 0, -1, 1.0, 0, 0, 2.0)], forest.NODE_SCHEMA)
    monkeypatch.setattr(trees, "MOST_NODES", 0)
    with pytest.raises(ValueError):
        trees.leaves(spark.createDataFrame([(1, [0.0])], "k int, x array<double>"), trees.node_table(nodes, "path"), 1, 1)


def test_optimality_tells_a_fit_from_an_early_stop(spark, table):
    rows = table.selectExpr("*", "amount AS log_amount")
    fitted = {k: categorizer.fit_categorizer(rows, numeric=["log_amount"], max_iterations=k, tolerance=1e-9) for k in (2, 900)}
    worst = {}
    for k, model in fitted.items():
        found = categorizer.optimality(rows, model, numeric=["log_amount"]).collect()
        assert {r.category: r.n for r in found} == {r.category: r["count"] for r in rows.groupBy("category").count().collect()}
        worst[k] = max(r.gradient for r in found)
    assert worst[900] < 1e-4 < 1e-2 < worst[2]


def test_a_fit_cuts_each_text_once(spark, table):
    cut = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        cut.add(1)
        return text

    categorizer.fit_categorizer(table.withColumn("merchant", counted.asNondeterministic()("merchant")), numeric=[], max_iterations=3)
    assert cut.value == table.count()


def test_entries_equal_the_vectors(spark, table):
    model = categorizer.fit_categorizer(table, numeric=["amount"], max_iterations=1)
    own = {}
    for r in categorizer.feature_entries(table, model, "txn_id", "merchant", ["amount"]).collect():
        own.setdefault(r.txn_id, {})[r.feature] = r.value
    for r in model.transform(table).select("txn_id", "features").collect():
        vector = {k: v for k, v in enumerate(r.features.toArray()) if v}
        assert own[r.txn_id].keys() == vector.keys() and all(abs(own[r.txn_id][k] - v) < 1e-12 for k, v in vector.items())


def test_forest_stage_in_a_saved_pipeline(spark, table, tmp_path):
    model, _ = forest.fit_isolation_forest(table, ["amount", "lat"], trees=10, sample_size=32)
    path = str(tmp_path / "pipeline")
    PipelineModel([IsolationForestStage(model)]).write().save(path)
    columns = ["txn_id", "anomaly_score", "decision", "is_anomaly"]
    loaded = PipelineModel.load(path)
    assert sorted(map(tuple, loaded.transform(table).select(*columns).collect())) == sorted(map(tuple, model.transform(table).select(*columns).collect()))
    alone = str(tmp_path / "alone")
    IsolationForestStage(model).write().overwrite().save(alone)
    part = next((tmp_path / "alone" / "metadata").glob("part-*"))
    for hidden in (tmp_path / "alone" / "metadata").glob(".part-*"):
        hidden.unlink()
    part.write_text(part.read_text().replace(f'"format": {FORMAT}', '"format": 99').replace(f'"format":{FORMAT}', '"format":99'))
    with pytest.raises(ValueError):
        IsolationForestStage.load(alone)
