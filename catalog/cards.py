"""Queries on risk features, rules, scores and alerts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalog.registry import longs, query, r, rounded
from catalog.views import RISK_SQL, flagged_sql, forest_sql, raw_risk
from ledgerline.functions.times import epoch_micros
from ledgerline.operators import forest, risk
from ledgerline.operators.cleaning import clean_risk
from ledgerline.operators.features import geo_distance
from ledgerline.plans import risk as plan
from ledgerline.session import stage

X = "WITH " + RISK_SQL
RISK_COLUMNS = ["txn_id", "merchant", "category", "amount", "city", "state", "cc_num"]


@query(
    "risk_base",
    f"""{X} SELECT txn_id, epoch_us(ts) AS micros, merchant, category, amount, city, state, cc_num, CAST(NULL AS DOUBLE) AS unix_time,
    cust_lat, cust_long, merch_lat, merch_long FROM g""",
)
def risk_base(spark, sf):
    micros = epoch_micros(F.col("timestamp")).alias("micros")
    rest = ["unix_time", "cust_lat", "cust_long", "merch_lat", "merch_long"]
    return clean_risk(risk.risk_base(raw_risk(spark, sf))).select(*RISK_COLUMNS, micros, *rest)


@query("geo_distance", f"{X} SELECT txn_id, CAST(geo_missing AS BIGINT) AS geo_missing, {r('geo_dist_km')} AS geo_dist_km FROM h")
def geo_distance_query(spark, sf):
    rows = geo_distance(risk.risk_base(raw_risk(spark, sf)))
    return longs(rounded(rows.select("txn_id", "geo_missing", "geo_dist_km"), geo_dist_km=4), "geo_missing")


def _features(spark, sf, baseline=False):
    return risk.risk_features(risk.risk_base(raw_risk(spark, sf)), baseline=baseline)


@query("risk_prev_delta", f"{X} SELECT txn_id, {r('prev_txn_delta_min')} AS prev_txn_delta_min FROM x")
def risk_prev_delta(spark, sf):
    return rounded(_features(spark, sf).select("txn_id", "prev_txn_delta_min"), prev_txn_delta_min=4)


@query(
    "risk_rolling",
    f"""{X} SELECT txn_id, roll_cnt_N AS "roll_cnt_N", {r('roll_sum_N')} AS "roll_sum_N", {r('roll_max_N')} AS "roll_max_N", {r('roll_mean_N', 6)} AS "roll_mean_N", {r('roll_std_N', 6)} AS "roll_std_N" FROM x""",
)
def risk_rolling(spark, sf):
    names = ["roll_sum_N", "roll_max_N", "roll_mean_N", "roll_std_N"]
    return rounded(_features(spark, sf).select("txn_id", "roll_cnt_N", *names), roll_sum_N=4, roll_max_N=4, roll_mean_N=6, roll_std_N=6)


@query("risk_amount_z", f"{X} SELECT txn_id, {r('amount_z', 6)} AS amount_z FROM x")
def risk_amount_z(spark, sf):
    return rounded(_features(spark, sf).select("txn_id", "amount_z"), amount_z=6)


@query("risk_merchant_concentration", f"{X} SELECT txn_id, {r('merchant_conc_ewm', 6)} AS merchant_conc_ewm FROM x")
def risk_merchant_concentration(spark, sf):
    return rounded(_features(spark, sf).select("txn_id", "merchant_conc_ewm"), merchant_conc_ewm=6)


@query("risk_swipe_flags", f"{X} SELECT txn_id, CAST(repeat_small_charge AS BIGINT) AS repeat_small_charge, CAST(rapid_swipes AS BIGINT) AS rapid_swipes FROM x")
def risk_swipe_flags(spark, sf):
    names = ["repeat_small_charge", "rapid_swipes"]
    return longs(_features(spark, sf).select("txn_id", *names), *names)


@query("risk_long_baseline", f"{X} SELECT txn_id, {r('long_baseline')} AS long_baseline FROM x")
def risk_long_baseline(spark, sf):
    return rounded(_features(spark, sf, baseline=True).select("txn_id", "long_baseline"), long_baseline=4)


# ------------------------------------------------------------------ rules and alerts


def _ruled(spark, sf, **cuts):
    """Rows with reasons; -amount_z stands in for the model decision, so that SQL can repeat it."""
    ruled = risk.apply_rules(_features(spark, sf, baseline=True), **cuts).withColumn("decision", -F.col("amount_z"))
    return stage(ruled, "ruled")


def _flagged(spark, sf, need_two=True, pct=99.0, **cuts):
    return risk.flag_alerts(risk.risk_score(_ruled(spark, sf, **cuts)), pct, need_two)


def _reasons(df, *columns):
    return df.select(*columns, F.array_join("reasons", ",").alias("reasons"))


FLAGS = {
    "high_z": "CAST(amount_z > 2.0 AS BIGINT)",
    "rapid_swipes": "CAST(rapid_swipes AS BIGINT)",
    "repeat_small": "CAST(repeat_small_charge AS BIGINT)",
    "geo_jump": "CAST(geo_dist_km > 1000 AS BIGINT)",
    "velocity_spike": "CAST(roll_sum_N > long_baseline * 4.5 AS BIGINT)",
}


@query("risk_rules", f"{X} SELECT txn_id, {', '.join(f'{sql} AS {name}' for name, sql in FLAGS.items())} FROM x")
def risk_rules(spark, sf):
    conditions = risk.rule_conditions(z_cut=2.0)
    flags = [met.cast("long").alias(name) for name, met in conditions.items()]
    return _features(spark, sf, baseline=True).select("txn_id", *flags)


@query("risk_reasons", f"WITH {flagged_sql(z_cut=2.0)} SELECT txn_id, CAST(hits AS BIGINT) AS hits, reasons FROM y")
def risk_reasons(spark, sf):
    ruled = risk.apply_rules(_features(spark, sf, baseline=True), z_cut=2.0)
    return _reasons(ruled, "txn_id", F.size("reasons").cast("long").alias("hits"))


@query("risk_score_norm", f"WITH {flagged_sql()} SELECT txn_id, {r('risk_score', 6)} AS risk_score FROM s")
def risk_score_norm(spark, sf):
    return rounded(risk.risk_score(_ruled(spark, sf)).select("txn_id", "risk_score"), risk_score=6)


@query("risk_threshold", f"WITH {flagged_sql()} SELECT {r('max(threshold)', 6)} AS threshold FROM z")
def risk_threshold(spark, sf):
    return rounded(_flagged(spark, sf).agg(F.max("threshold").alias("threshold")), threshold=6)


def _alert_sql(**options) -> str:
    return f"""WITH {flagged_sql(**options)} SELECT txn_id, merchant, category, amount, city, state, cc_num, {r('risk_score', 6)} AS risk_score, reasons
    FROM z WHERE is_alert"""


def _alerts(flagged):
    rows = risk.alerts_only(flagged)
    return rounded(_reasons(rows, *RISK_COLUMNS, "risk_score"), risk_score=6)


@query("risk_alerts", _alert_sql())
def risk_alerts(spark, sf):
    return _alerts(_flagged(spark, sf))


@query("risk_alerts_one_rule", _alert_sql(z_cut=2.0, rules=1))
def risk_alerts_one_rule(spark, sf):
    return _alerts(_flagged(spark, sf, need_two=False, z_cut=2.0))


@query(
    "risk_kpis",
    f"""WITH {flagged_sql()} SELECT count(*) AS total, count(CASE WHEN is_alert THEN 1 END) AS alerts,
    {r('100.0 * count(CASE WHEN is_alert THEN 1 END) / count(*)')} AS alert_rate_pct, {r('max(threshold)', 6)} AS threshold FROM z""",
)
def risk_kpis(spark, sf):
    return rounded(risk.risk_kpis(_flagged(spark, sf)), alert_rate_pct=4, threshold=6)


@query(
    "alert_reason_counts",
    f"""WITH {flagged_sql(z_cut=2.0)}, e AS (SELECT unnest(string_split(reasons, ',')) AS reason FROM z WHERE is_alert AND reasons <> '')
    SELECT reason, count(*) AS n FROM e GROUP BY 1""",
)
def alert_reason_counts(spark, sf):
    return risk.alert_reason_counts(_flagged(spark, sf, z_cut=2.0))


@query(
    "alert_explorer",
    f"""WITH {flagged_sql(z_cut=2.0, rules=1)} SELECT txn_id, merchant, amount, city, {r('risk_score', 6)} AS risk_score, reasons FROM z
    WHERE is_alert AND (reasons LIKE '%high_z%' OR reasons LIKE '%geo_jump%') AND (contains(merchant, 'store') OR contains(city, 'store')) AND amount >= 5
    ORDER BY round(z.risk_score, 9) DESC, txn_id LIMIT 500""",
)
def alert_explorer(spark, sf):
    flagged = _flagged(spark, sf, need_two=False, z_cut=2.0)
    # Rounded before the cut to 500 rows, so that both engines break ties alike.
    flagged = flagged.withColumn("risk_score", F.round("risk_score", 9))
    found = risk.explore_alerts(flagged, ["high_z", "geo_jump"], "Store", 5.0)
    return rounded(_reasons(found, "txn_id", "merchant", "amount", "city", "risk_score"), risk_score=6)


@query(
    "score_histogram",
    f"""WITH {flagged_sql()}, b AS (SELECT min(risk_score) AS lo, max(risk_score) AS hi FROM s),
    n AS (SELECT least(floor((risk_score - lo) / ((hi - lo) / 50)), 49) AS bin, lo, (hi - lo) / 50 AS width FROM s, b)
    SELECT CAST(bin + 1 AS BIGINT) AS bin, {r('any_value(lo + bin * width)', 6)} AS bin_from, count(*) AS n FROM n GROUP BY 1""",
)
def score_histogram(spark, sf):
    return longs(rounded(risk.score_histogram(risk.risk_score(_ruled(spark, sf))), bin_from=6), "bin")


@query(
    "risk_manifest",
    f"""WITH {flagged_sql()} SELECT count(*) AS total_rows, count(CASE WHEN is_alert THEN 1 END) AS alerts,
    {r('100.0 * count(CASE WHEN is_alert THEN 1 END) / count(*)', 2)} AS alert_rate_pct, 99.0::DOUBLE AS threshold_percentile, {r('max(threshold)', 6)} AS numeric_threshold,
    TRUE AS need_two_rules, 4.0::DOUBLE AS z_cut, CAST(1000 AS BIGINT) AS geo_km, 4.5::DOUBLE AS vel_mul FROM z""",
)
def risk_manifest(spark, sf):
    manifest = risk.run_manifest(_flagged(spark, sf)).select("*", "rules.*").drop("generated_at", "rules")
    return longs(rounded(manifest, numeric_threshold=6), "geo_km")


# ------------------------------------------------------------------ forest


# A fixed forest of four trees: tree, node, feature, threshold, left, right, path. A leaf points to itself.
FOREST_FEATURES = ["amount", "amount_z", "geo_dist_km", "prev_txn_delta_min", "merchant_conc_ewm"]
FOREST_NODES = [
    (0, 0, 1, 1.53217, 1, 2, 0.0), (0, 1, 0, 55.31931, 3, 4, 0.0), (0, 2, 2, 611.70013, 5, 6, 0.0), (0, 3, -1, 1e300, 3, 3, 9.25),
    (0, 4, -1, 1e300, 4, 4, 8.5), (0, 5, -1, 1e300, 5, 5, 5.5), (0, 6, -1, 1e300, 6, 6, 2.0),
    (1, 0, 2, 350.12347, 1, 2, 0.0), (1, 1, 4, 0.23571, 3, 4, 0.0), (1, 2, -1, 1e300, 2, 2, 4.75), (1, 3, -1, 1e300, 3, 3, 9.5), (1, 4, -1, 1e300, 4, 4, 7.25),
    (2, 0, 3, 61.70009, 1, 2, 0.0), (2, 1, 1, 0.81113, 3, 4, 0.0), (2, 2, 0, 20.00071, 5, 6, 0.0), (2, 3, -1, 1e300, 3, 3, 6.5),
    (2, 4, 0, 90.10017, 7, 8, 0.0), (2, 5, -1, 1e300, 5, 5, 8.75), (2, 6, -1, 1e300, 6, 6, 9.0), (2, 7, -1, 1e300, 7, 7, 5.0), (2, 8, -1, 1e300, 8, 8, 3.0),
    (3, 0, -1, 1e300, 0, 0, 8.0),
]
FOREST = forest.IsolationForestModel(
    FOREST_FEATURES, 256, 3, -0.58, pd.DataFrame(FOREST_NODES, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])
)
FOREST_SQL = forest_sql("x", FOREST_FEATURES, FOREST_NODES, 3, 256, -0.58)


@query("forest_score", f"{X}{FOREST_SQL} SELECT txn_id, {r('anomaly_score', 9)} AS anomaly_score FROM found")
def forest_score(spark, sf):
    return rounded(FOREST.score_in_joins(_features(spark, sf)).select("txn_id", "anomaly_score"), anomaly_score=9)


@query("forest_flags", f"{X}{FOREST_SQL} SELECT txn_id, {r('forest_decision', 9)} AS decision, forest_decision < 0 AS is_anomaly FROM found")
def forest_flags(spark, sf):
    flagged = FOREST.decide(FOREST.score_in_joins(_features(spark, sf)))
    return rounded(flagged.select("txn_id", "decision", "is_anomaly"), decision=9)


@query(
    "forest_alerts",
    f"""WITH {flagged_sql(z_cut=2.0, model=FOREST_SQL, rows="found", decision="forest_decision")}
    SELECT txn_id, merchant, {r('amount')} AS amount, reasons, {r('risk_score', 6)} AS risk_score FROM z WHERE is_alert""",
)
def forest_alerts(spark, sf):
    """Rules and the score of the fixed forest together, as the scoring plan puts them."""
    scored = FOREST.decide(FOREST.score_in_joins(_features(spark, sf, baseline=True)))
    alerts = risk.alerts_only(risk.flag_alerts(risk.risk_score(stage(risk.apply_rules(scored, z_cut=2.0), "forest-alerts"))))
    return rounded(_reasons(alerts, "txn_id", "merchant", "amount", "risk_score"), amount=4, risk_score=6)


@query("risk_iforest")
def risk_iforest(spark, sf):
    features = stage(_features(spark, sf), "risk-features")
    _, scored = forest.fit_isolation_forest(features, risk.RISK_FEATURES, plan.TREES, plan.SAMPLE_SIZE, plan.CONTAMINATION)
    return scored.select("txn_id", "anomaly_score", "decision", "is_anomaly")


@query("risk_score_batch")
def risk_score_batch(spark, sf):
    raw = raw_risk(spark, sf)
    alerts = plan.score_transactions(raw, plan.fit_risk_model(raw))
    return _reasons(alerts, *RISK_COLUMNS, "risk_score")
