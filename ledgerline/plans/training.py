"""Training of the category model: prepare, sample, split, fit, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.categorizer import MAX_ITERATIONS, categorize, fit_categorizer
from ledgerline.operators.cleaning import clean, drop_incomplete
from ledgerline.operators.evaluate import class_report, confusion, f1_scores, prediction_sample
from ledgerline.operators.features import model_features, quantile_edges
from ledgerline.operators.sampling import stratified_sample, stratified_split
from ledgerline.session import stage, with_row_key
from ledgerline.sources.headers import align_strict

TRAINING_BINS = 5
SAMPLE_ROWS = 300_000


def prepare_training(df: DataFrame) -> DataFrame:
    """Six raw columns and a row key, cleaned; rows without time, amount or label are left out."""
    aligned = align_strict(df, keep=("txn_id",) if "txn_id" in df.columns else ())
    return drop_incomplete(clean(with_row_key(aligned)), also=("category",))


@dataclass
class TrainedCategorizer:
    model: PipelineModel
    edges: list[float]  # amount-bin edges of the training rows, to be used at serving too
    validated: DataFrame  # hold-out rows with ``true`` and ``pred``

    def scores(self) -> DataFrame:
        return f1_scores(self.validated)

    def report(self) -> DataFrame:
        return class_report(self.validated)

    def confusion(self) -> DataFrame:
        return confusion(self.validated)

    def sample(self, n: int = 200) -> DataFrame:
        return prediction_sample(self.validated, n=n)


def train_categorizer(
    prepared: DataFrame, sample_rows: int = SAMPLE_ROWS, test_share: float = 0.2, seed: int = 42,
    max_iterations: int = MAX_ITERATIONS,
) -> TrainedCategorizer:
    """Fit on a stratified sample and score a stratified hold-out. Bin edges are saved, not refitted."""
    edges = quantile_edges(prepared, TRAINING_BINS)
    sample = stratified_sample(model_features(prepared, edges=edges), "category", sample_rows, seed)
    rows = stage(stratified_split(sample, "category", test_share, seed), "training-rows")
    model = fit_categorizer(rows.where(F.col("split") == "train"), max_iterations=max_iterations)
    held_out = categorize(rows.where(F.col("split") == "test"), model)
    validated = held_out.withColumnsRenamed({"category": "true", "pred_category": "pred"})
    return TrainedCategorizer(model, edges, validated)


def save_categorizer(spark: SparkSession, path: str, model: PipelineModel, edges: list[float]) -> None:
    """The model, and next to it the bin edges that serving needs."""
    model.write().save(f"{path}/model")
    spark.createDataFrame([(edges,)], "edges array<double>").coalesce(1).write.json(f"{path}/edges")


def load_categorizer(spark: SparkSession, path: str) -> tuple[PipelineModel, list[float]]:
    edges = spark.read.schema("edges array<double>").json(f"{path}/edges").first()["edges"]
    return PipelineModel.load(f"{path}/model"), list(edges)
