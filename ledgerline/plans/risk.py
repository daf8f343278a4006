"""Risk model training and the scoring of new transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerline.operators.forest import IsolationForestModel, fit_isolation_forest
from ledgerline.operators.risk import (
    GEO_KM,
    PERCENTILE,
    RISK_FEATURES,
    VELOCITY,
    Z_CUT,
    alerts_only,
    apply_rules,
    flag_alerts,
    risk_base,
    risk_features,
    risk_score,
)
from ledgerline.session import stage

# Settings of the risk forest.
TREES = 256
SAMPLE_SIZE = 512
CONTAMINATION = 0.02


def fit_risk_model(df: DataFrame, seed: int = 42) -> IsolationForestModel:
    features = stage(risk_features(risk_base(df), model_only=True).select("txn_id", *RISK_FEATURES), "risk-features")
    model, _ = fit_isolation_forest(features, RISK_FEATURES, TREES, SAMPLE_SIZE, CONTAMINATION, seed)
    return model


def flag_transactions(
    df: DataFrame,
    model: IsolationForestModel,
    pct: float = PERCENTILE,
    z_cut: float = Z_CUT,
    geo_km: float = GEO_KM,
    vel_mul: float = VELOCITY,
    need_two: bool = True,
) -> DataFrame:
    """All rows with score, reasons and alert flag. Scored rows are staged: several passes read them."""
    features = risk_features(risk_base(df), baseline=True)
    scored = stage(apply_rules(model.transform(features), z_cut, geo_km, vel_mul), "risk-scores")
    return flag_alerts(risk_score(scored), pct, need_two)


def score_transactions(
    df: DataFrame,
    model: IsolationForestModel,
    pct: float = PERCENTILE,
    z_cut: float = Z_CUT,
    geo_km: float = GEO_KM,
    vel_mul: float = VELOCITY,
    need_two: bool = True,
) -> DataFrame:
    """Alerts of a new table of transactions, highest score first."""
    return alerts_only(flag_transactions(df, model, pct, z_cut, geo_km, vel_mul, need_two))
