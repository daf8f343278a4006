"""Risk features, rules, scores and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import times
from ledgerline.operators.cleaning import clean_risk
from ledgerline.operators.features import geo_distance
from ledgerline.operators.quantiles import quantile_value
from ledgerline.operators.sequence import sequence_features
from ledgerline.session import with_row_key
from ledgerline.sources.headers import RISK_HEADERS

# Model features, columns the sequence features are made of, rules in their order, and default limits.
RISK_FEATURES = [
    "hour", "dayofweek", "is_weekend", "amount", "amount_z", "roll_cnt_N", "roll_sum_N", "roll_max_N",
    "prev_txn_delta_min", "merchant_conc_ewm", "rapid_swipes", "repeat_small_charge", "geo_dist_km",
]
SEQUENCE_COLUMNS = ["cc_num", "timestamp", "merchant", "amount"]
RULES = ["high_z", "rapid_swipes", "repeat_small", "geo_jump", "velocity_spike"]
Z_CUT = 4.0
GEO_KM = 1000.0
VELOCITY = 4.5
PERCENTILE = 99.0
SCORE_EPSILON = 1e-9
ALERT_COLUMNS = [
    "timestamp", "merchant", "category", "amount", "city", "state", "cc_num", "risk_score", "is_alert", "reasons",
]

_TYPES = {"timestamp": "timestamp_ntz", "cc_num": "bigint", "unix_time": "double", "amount": "double"}
_TYPES |= dict.fromkeys(["cust_lat", "cust_long", "merch_lat", "merch_long"], "double")


def risk_base(df: DataFrame, label: bool = False) -> DataFrame:
    """The twelve risk columns from raw headers, absent ones as typed NULLs, and a row key.

    Canonical names are accepted too. A table without ``txn_id`` is numbered and staged.
    """
    headers = RISK_HEADERS | ({"is_fraud": "is_fraud"} if label else {})
    key = ["txn_id"] if "txn_id" in df.columns else []

    def source(raw: str, name: str) -> Column:
        for candidate in (raw, name):
            if candidate in df.columns:
                return F.col(f"`{candidate}`")
        return F.lit(None).cast(_TYPES.get(name, "string"))

    columns = [source(raw, name).alias(name) for raw, name in headers.items()]
    base = with_row_key(df.select(*key, *columns))
    if isinstance(base.schema["cc_num"].dataType, T.StringType):
        # Card numbers read from text are the same card with and without blanks or leading zeros.
        number = F.trim("cc_num").try_cast("bigint").cast("string")
        base = base.withColumn("cc_num", F.coalesce(number, F.nullif(F.trim("cc_num"), F.lit(""))))
    return base


def risk_features(df: DataFrame, baseline: bool = False, model_only: bool = False, **options) -> DataFrame:
    """Clean risk rows with sequence, calendar and distance features.

    ``model_only`` leaves out, before the rows are ordered, the columns that no model feature is made of.
    """
    ts = F.col("timestamp")
    rows = geo_distance(clean_risk(df)).withColumns(
        {"hour": F.hour(ts), "dayofweek": times.day_of_week(ts), "is_weekend": times.is_weekend(ts)}
    )
    if model_only:
        rows = rows.select("txn_id", *SEQUENCE_COLUMNS, *[c for c in RISK_FEATURES if c in rows.columns and c not in SEQUENCE_COLUMNS])
    return sequence_features(rows, baseline=baseline, **options)


def rule_conditions(z_cut: float = Z_CUT, geo_km: float = GEO_KM, vel_mul: float = VELOCITY) -> dict[str, Column]:
    conditions = [
        F.col("amount_z") > z_cut,
        F.col("rapid_swipes") == 1,
        F.col("repeat_small_charge") == 1,
        F.col("geo_dist_km") > geo_km,
        F.col("roll_sum_N") > F.col("long_baseline") * vel_mul,
    ]
    return dict(zip(RULES, conditions))


def apply_rules(features: DataFrame, z_cut: float = Z_CUT, geo_km: float = GEO_KM, vel_mul: float = VELOCITY) -> DataFrame:
    """``reasons``: names of the rules a row meets, in rule order. Needs ``long_baseline``."""
    hits = [F.when(met, F.lit(name)) for name, met in rule_conditions(z_cut, geo_km, vel_mul).items()]
    return features.withColumn("reasons", F.array_compact(F.array(*hits)))


def risk_score(df: DataFrame, decision: str = "decision") -> DataFrame:
    """``risk_score`` from a model decision (higher is more normal): (-d - min) / (max - min).

    The range is shifted rather than [0, 1]; order and percentiles do not depend on that. The two
    limits are fetched once, so that readers of the result do not look for them again: pass a staged
    or persisted table.
    """
    low, high = df.agg(F.min(decision), F.max(decision)).first()
    span = F.lit(high).cast("double") - F.lit(low).cast("double") + SCORE_EPSILON
    return df.withColumn("risk_score", (-F.col(decision) - F.lit(low).cast("double")) / span)


def risk_threshold(scored: DataFrame, pct: float = PERCENTILE) -> float | None:
    """The score at percentile ``pct``, exact; None for an empty table."""
    return quantile_value(scored, "risk_score", pct / 100.0)


def flag_alerts(scored: DataFrame, pct: float = PERCENTILE, need_two: bool = True) -> DataFrame:
    """``threshold`` and ``is_alert``: a high score, or enough rules met (two, or one)."""
    needed = 2 if need_two else 1
    threshold = F.lit(risk_threshold(scored, pct)).cast("double")
    flag = (F.col("risk_score") >= threshold) | (F.size("reasons") >= needed)
    return scored.withColumns({"threshold": threshold, "is_alert": flag})


def alerts_only(flagged: DataFrame) -> DataFrame:
    """Alert rows in the result layout, highest score first."""
    present = [c for c in ["txn_id", *ALERT_COLUMNS] if c in flagged.columns]
    return flagged.where("is_alert").select(*present).orderBy(F.desc("risk_score"), "txn_id")


def risk_kpis(flagged: DataFrame) -> DataFrame:
    counts = flagged.agg(
        F.count("*").alias("total"), F.count_if("is_alert").alias("alerts"), F.max("threshold").alias("threshold")
    )
    rate = 100.0 * F.col("alerts") / F.greatest(F.col("total"), F.lit(1))
    return counts.select("total", "alerts", rate.alias("alert_rate_pct"), "threshold")


def reason_counts(df: DataFrame, reasons: str = "reasons") -> DataFrame:
    """How often each reason occurs, most frequent first."""
    exploded = df.select(F.explode(reasons).alias("reason"))
    return exploded.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def alert_reason_counts(flagged: DataFrame) -> DataFrame:
    return reason_counts(flagged.where("is_alert"))


def explore_alerts(
    flagged: DataFrame, reasons: list[str] | None = None, text: str = "", min_amount: float = 0.0, top: int = 500
) -> DataFrame:
    """Alerts with any of the reasons, the text in merchant or city, and a least amount."""
    keep = F.col("is_alert") & (F.col("amount") >= min_amount)
    if reasons:
        keep = keep & F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in reasons]))
    wanted = text.strip().lower()
    if wanted:
        places = [F.coalesce(F.col(c).contains(wanted), F.lit(False)) for c in ("merchant", "city") if c in flagged.columns]
        hit = places[0]
        for place in places[1:]:
            hit = hit | place
        keep = keep & hit
    present = [c for c in ["txn_id", *ALERT_COLUMNS] if c in flagged.columns]
    return flagged.where(keep).select(*present).orderBy(F.desc("risk_score"), "txn_id").limit(top)


def score_histogram(df: DataFrame, score: str = "risk_score", bins: int = 50) -> DataFrame:
    """Rows per bin between the least and greatest score; the greatest is in the last bin."""
    low, high = df.agg(F.min(score).cast("double"), F.max(score).cast("double")).first()
    width = (high - low) / bins if low is not None and high > low else 0.0
    number = F.floor((F.col(score) - low) / width) if width else F.lit(0)
    return (
        df.where(F.col(score).isNotNull())
        .groupBy((F.least(number, F.lit(bins - 1)) + 1).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .select("bin", (F.lit(low).cast("double") + (F.col("bin") - 1) * width).alias("bin_from"), "n")
        .orderBy("bin")
    )


def run_manifest(
    flagged: DataFrame,
    pct: float = PERCENTILE,
    need_two: bool = True,
    z_cut: float = Z_CUT,
    geo_km: float = GEO_KM,
    vel_mul: float = VELOCITY,
) -> DataFrame:
    """One row that describes a run, for a JSON sink."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return risk_kpis(flagged).select(
        now.alias("generated_at"),
        F.col("total").alias("total_rows"),
        "alerts",
        F.round("alert_rate_pct", 2).alias("alert_rate_pct"),
        F.lit(float(pct)).alias("threshold_percentile"),
        F.col("threshold").alias("numeric_threshold"),
        F.struct(
            F.lit(need_two).alias("need_two_rules"),
            F.lit(float(z_cut)).alias("z_cut"),
            F.lit(int(geo_km)).alias("geo_km"),
            F.lit(float(vel_mul)).alias("vel_mul"),
        ).alias("rules"),
    )
