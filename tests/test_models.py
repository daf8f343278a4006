"""Category and batch models, and the runs around them."""

import datetime as dt

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ledgerline.operators import batch, categorizer
from ledgerline.operators.anomalies import multi_dim_anomalies
from ledgerline.plans import insights, risk, training

WORDS = {"food": "burger grill", "fuel": "petrol pump", "travel": "airline tickets"}


@pytest.fixture(scope="module")
def raw(spark):
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(360):
        category = list(WORDS)[i % 3]
        time = (start + dt.timedelta(hours=7 * i)).isoformat(sep=" ")
        rows.append((i, time, i % 6, f"{WORDS[category]} #{i % 9}", category, str(10.0 * (i % 3 + 1) + i % 5), "X", "Y"))
    names = "txn_id long, trans_date_trans_time string, cc_num long, merchant string, category string, amt string, city string, state string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def trained(raw):
    return training.train_categorizer(training.prepare_training(raw), sample_rows=300, max_iterations=50)


def test_training_learns_the_words(trained):
    assert trained.validated.count() == 60
    scores = trained.scores().first()
    assert scores.macro_f1 > 0.95 and scores.weighted_f1 > 0.95
    assert len(trained.edges) == 6
    assert trained.report().count() == 3 and trained.confusion().count() == 9
    assert trained.sample(10).count() == 10


def test_model_survives_saving(spark, raw, trained, tmp_path):
    training.save_categorizer(spark, str(tmp_path / "saved"), trained.model, trained.edges)
    model, edges = training.load_categorizer(spark, str(tmp_path / "saved"))
    assert edges == trained.edges
    found = [
        insights.facts_from_raw(raw, *saved).orderBy("txn_id").collect()
        for saved in ((trained.model, trained.edges), (model, edges))
    ]
    assert found[0] == found[1] and len(found[0]) == 360
    assert sum(r.category == r.pred_category for r in found[0]) > 340


def test_facts_without_a_model_use_the_given_category(raw):
    facts = insights.facts_from_raw(raw)
    assert facts.where(F.col("category") != F.col("pred_category")).count() == 0
    assert {"date", "week", "month", "merchant_raw"} <= set(facts.columns)


def test_tfidf_is_smooth_and_normal(spark):
    df = spark.createDataFrame([("aa bb",), ("aa cc",), ("aa bb",), ("bb",)], "text string")
    stats = {r.term: (r.df, round(r.idf, 6)) for r in categorizer.term_statistics(df, "text").collect()}
    assert stats == {"aa": (3, 1.223144), "bb": (3, 1.223144)}
    model = PipelineModel(categorizer.fit_text(df, "text"))
    vector = model.transform(df).first().tfidf
    assert vector.norm(2) == pytest.approx(1.0) and vector.numNonzeros() == 2


def test_state_option(raw):
    prepared = training.prepare_training(raw)
    model = categorizer.fit_categorizer(prepared, numeric=[], state="state", max_iterations=10)
    unseen = prepared.limit(5).withColumn("state", F.lit("elsewhere"))
    assert categorizer.categorize(unseen, model, numeric=[]).count() == 5


@pytest.mark.parametrize("kind", batch.MODELS)
def test_batch_classifier(raw, kind):
    from ledgerline.operators.cleaning import clean_batch
    from ledgerline.sources.headers import align_batch

    rows = clean_batch(align_batch(raw))
    model = batch.fit_batch_classifier(rows, kind=kind, trees=10, max_depth=5, hidden=(8,), max_iterations=100)
    found = batch.batch_classify(rows.drop("cc_num"), model)  # an absent feature counts as 0
    assert found.columns == ["txn_id", "timestamp", "merchant", "amount", "predicted_category"]
    joined = batch.batch_classify(rows, model).join(raw.select("txn_id", "category"), "txn_id")
    assert joined.where(F.col("category") == F.col("predicted_category")).count() > 250


def test_tables_without_a_row_key(raw):
    copies = raw.drop("txn_id").unionAll(raw.drop("txn_id"))
    assert training.prepare_training(copies).select("txn_id").distinct().count() == 720
    flagged = risk.flag_transactions(copies, risk.fit_risk_model(copies))
    assert flagged.select("txn_id").distinct().count() == flagged.count() == 720
    found = multi_dim_anomalies(insights.facts_from_raw(raw.drop("txn_id")))
    assert "txn_id" not in found.columns and 0 < found.count() <= 19


def test_unknown_kind(raw):
    with pytest.raises(ValueError):
        batch.fit_batch_classifier(raw, kind="svm")


def test_scoring_a_new_table(raw):
    model = risk.fit_risk_model(raw)
    flagged = risk.flag_transactions(raw, model, pct=95.0)
    assert flagged.count() == 360
    assert 18 <= flagged.where(F.col("risk_score") >= F.col("threshold")).count() <= 19
    alerts = risk.score_transactions(raw, model, pct=95.0).collect()
    scores = [r.risk_score for r in alerts]
    assert scores == sorted(scores, reverse=True) and all(r.is_alert for r in alerts)
