"""Hand-made tables with results worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import times
from ledgerline.functions.numbers import bin_fixed, haversine_km, log_amount
from ledgerline.functions.values import normal_text, number_from_text, timestamp_from_text
from ledgerline.operators import affinity, budget, cleaning, evaluate, facts, features, forecast, insights, patterns, profile, risk, visits
from ledgerline.sources.headers import SchemaError, align_batch, align_canonical, align_strict, match_schema, normalize_header

FACTS = "txn_id long, timestamp timestamp_ntz, merchant string, amount double, pred_category string"


def make(spark, rows):
    """Rows of (time, merchant, amount, category)."""
    numbered = [(i, dt.datetime.fromisoformat(t), m, a, c) for i, (t, m, a, c) in enumerate(rows)]
    return facts.make_facts(spark.createDataFrame(numbered, FACTS))


def column(df, name):
    return [row[name] for row in df.collect()]


def amounts(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "amount double")


@pytest.mark.parametrize(
    "values, expected",
    [([1, 2, 3, 4, 5, 6, 7, 8], [0, 0, 1, 1, 2, 2, 3, 3]), ([1, 1, 1, 1, 2], [0] * 5), ([5, 5, 5], [None] * 3)],
)
def test_quantile_bins(spark, values, expected):
    assert column(features.amount_bin(amounts(spark, values)).orderBy("amount"), "amount_bin") == expected


def test_given_and_fixed_bins(spark):
    df = amounts(spark, [-1, 0, 5, 10, 11, 50, 51])
    assert column(features.amount_bin(df, edges=[0.0, 10.0, 50.0]), "amount_bin") == [None, 0, 0, 0, 1, 1, None]
    assert column(df.select(bin_fixed(F.col("amount")).alias("b")), "b") == [0, 0, 0, 0, 1, 1, 2]


def test_log_amount(spark):
    found = column(amounts(spark, [-2, -1, 0, math.e - 1]).select(log_amount(F.col("amount")).alias("x")), "x")
    assert found[:3] == [None, None, 0.0] and found[3] == pytest.approx(1.0)


def test_periods_and_day_names(spark):
    hours = spark.range(24).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int))").alias("t"))
    found = column(hours.select(times.period_of_day(F.col("t")).alias("p")), "p")
    assert found == ["Night"] * 7 + ["Morning"] * 6 + ["Afternoon"] * 6 + ["Evening"] * 5
    assert column(hours.select(times.day_name(F.col("t")).alias("d")).limit(1), "d") == ["Monday"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_micros_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.123456' as t, timestamp_ntz'1969-12-31 23:59:59.5' as u")
        row = df.select(times.epoch_micros(F.col("t")).alias("t"), times.epoch_micros(F.col("u")).alias("u")).first()
        assert (row.t, row.u) == (1_710_037_800_123_456, -500_000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_parsing(spark):
    texts = ["2024-01-02 03:04:05.5", " 2024-1-2 ", "2024", "02/03/2024 10:11", "13/02/2024", "31/31/2024", "x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    d = dt.datetime
    found = df.select(timestamp_from_text(F.col("x")).alias("a"), timestamp_from_text(F.col("x"), day_first=True).alias("b")).collect()
    assert [r.a for r in found] == [d(2024, 1, 2, 3, 4, 5, 500000), d(2024, 1, 2), None, d(2024, 2, 3, 10, 11), d(2024, 2, 13)] + [None] * 4
    assert [r.b for r in found][3:5] == [d(2024, 3, 2, 10, 11), d(2024, 2, 13)]
    numbers = ["1", " -2.5e3 ", ".5", "1.0d", "1f", "inf", "NaN", "1e999", "$1,234.50", "", None]
    df = spark.createDataFrame([(n,) for n in numbers], "x string")
    found = df.select(number_from_text(F.col("x")).alias("a"), number_from_text(F.col("x"), currency=True).alias("b")).collect()
    assert [r.a for r in found] == [1.0, -2500.0, 0.5] + [None] * 8
    assert found[8].b == 1234.5


def test_text(spark):
    texts = ["  Café  N°5, Ltd. ", "A_b-C", "\tx y\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(normal_text(F.col("x")).alias("y"))
    assert column(df, "y") == ["café n 5 ltd", "a_b c", "x y", ""]


def test_distance(spark):
    row = spark.range(1).select(haversine_km(*[F.lit(float(x)) for x in (0, 0, 0, 180)]).alias("d")).first()
    assert row.d == pytest.approx(math.pi * 6371.0088)


def test_headers():
    assert normalize_header(" Txn_Amt! ") == "txnamt"
    match = match_schema(["id", "Date", "Payee", "txn_amt", "Amount"])
    assert match.found == {"timestamp": "Date", "merchant": "Payee", "amount": "txn_amt"} and not match.missing
    assert match_schema(["gross amount total", "posted ts", "narrative"]).missing == []
    # One column cannot be both the merchant and its own category, nor serve twice by keyword.
    assert match_schema(["merchant_date", "amount"]).missing == ["merchant"]
    with pytest.raises(SchemaError):
        match_schema(["Amount", "amount ", "date", "merchant"])


def test_alignment_errors(spark):
    df = spark.createDataFrame([(1,)], "x int")
    for align in (align_canonical, align_strict, align_batch):
        with pytest.raises(SchemaError):
            align(df)


def test_weekly_series_fills_gaps(spark):
    df = make(spark, [("2024-01-07T15:00", "a", 5.0, "c"), ("2024-01-08T00:00", "a", 7.0, "c"), ("2024-01-25T10:00", "a", 9.0, "c")])
    found = [(str(r.bucket), r.total, r.n, r.mean) for r in insights.spend_series(df).orderBy("bucket").collect()]
    assert found == [("2024-01-07", 5.0, 1, 5.0), ("2024-01-14", 7.0, 1, 7.0), ("2024-01-21", 0.0, 0, None), ("2024-01-28", 9.0, 1, 9.0)]


def test_category_without_spread_has_no_z(spark):
    df = make(spark, [("2024-01-01", "a", 5.0, "one"), ("2024-01-01", "a", 5.0, "same"), ("2024-01-02", "a", 5.0, "same")])
    assert insights.high_spend_z(df).count() == 0


def test_recurring_charge(spark):
    rows = [("2024-01-01T10:00", "gym", 10.0, "c"), ("2024-01-31T10:00", "gym", 10.0, "c"), ("2024-03-01T10:00", "gym", 10.1, "c")]
    rows += [("2024-01-01T10:00", "twice", 1.0, "c"), ("2024-01-31T10:00", "twice", 1.0, "c")]
    rows += [(f"2024-01-0{i}T10:00", "daily", 1.0, "c") for i in range(1, 6)]
    found = visits.recurring_charges(make(spark, rows)).collect()
    assert len(found) == 1
    row = found[0]
    assert (row.merchant, row.n, row.median_interval_days) == ("gym", 3, 30.0)
    assert (row.last_seen, row.next_estimated) == (dt.datetime(2024, 3, 1, 10), dt.datetime(2024, 3, 31, 10))
    assert row.amount_cv == pytest.approx(0.0577350269 / 10.0333333, rel=1e-6)


def test_same_day_visits_count_as_zero_gaps(spark):
    rows = [("2024-01-01T12:00", "a", 1.0, "c"), ("2024-01-01T13:00", "a", 1.0, "c"), ("2024-01-03T11:00", "a", 1.0, "c")]
    gaps = visits.merchant_days(make(spark, rows)).orderBy("day").collect()
    assert [(g.visits, g.gap) for g in gaps] == [(2, None), (1, 1)]
    due = visits.merchants_due(make(spark, rows), "2024-01-03").collect()
    assert due == [] or due[0].avg_interval_days == 0.5
    assert visits.merchants_due(make(spark, rows), "2024-01-10").first().avg_interval_days == 0.5


def test_budget(spark):
    df = make(spark, [("2024-01-05", "a", 30.0, "food"), ("2024-02-05", "a", 50.0, "food"), ("2024-02-06", "a", 50.0, "fun")])
    budgets = spark.createDataFrame([("food", 100.0), ("fun", 0.0), ("rent", 10.0)], "category string, budget double")
    found = {r.category: r for r in budget.budget_vs_actual(df, budgets).collect()}
    assert (found["food"].pct_used, found["food"].status) == (50.0, "green")
    assert (found["fun"].pct_used, found["fun"].variance) == (0.0, -50.0)
    assert found["rent"].actual == 0.0
    assert (found["TOTAL"].budget, found["TOTAL"].actual, found["TOTAL"].status) == (110.0, 100.0, None)
    assert budget.budget_vs_actual(df, budgets.limit(0)).count() == 0


def test_trend_needs_three_weeks(spark):
    weeks = [(f"2024-01-{d:02d}", "a", float(d), "c") for d in (1, 8, 15, 22)]
    assert patterns.spending_trend(make(spark, weeks[:2])).first().spending_trend == "stable"
    assert patterns.spending_trend(make(spark, weeks)).first().spending_trend == "increasing"


def test_forecast_needs_history(spark):
    rows = [(f"2024-{m:02d}-{d:02d}", "a", float(m), "c") for m in (1, 2, 4) for d in range(1, 11)]
    assert forecast.projected_next_month(make(spark, rows)).first()[0] == pytest.approx(70 / 3)
    assert column(forecast.growing_categories(make(spark, rows)), "category") == ["c"]
    assert forecast.projected_next_month(make(spark, rows[:29])).count() == 0
    assert forecast.growing_categories(make(spark, rows[:29])).count() == 0


def test_rules_and_explorer(spark):
    rows = [(1, "shop", "paris", 9.0, 4.5, 1, 0, 0.0, 10.0, 9.0, 0.2), (2, "shop", "rome", 3.0, 0.0, 0, 1, 1200.0, 10.0, 1.0, 0.9), (3, "bar", "rome", 1.0, 0.0, 0, 0, 0.0, 1.0, 1.0, 0.1)]
    df = spark.createDataFrame(
        rows, "txn_id long, merchant string, city string, amount double, amount_z double, rapid_swipes int, "
        "repeat_small_charge int, geo_dist_km double, roll_sum_N double, long_baseline double, decision double",
    )
    flagged = risk.flag_alerts(risk.risk_score(risk.apply_rules(df)), pct=99.9)
    reasons = {r.txn_id: r.reasons for r in flagged.collect()}
    assert reasons == {1: ["high_z", "rapid_swipes"], 2: ["repeat_small", "geo_jump", "velocity_spike"], 3: []}
    assert {r.txn_id for r in flagged.where("is_alert").collect()} == {1, 2, 3}  # 3 has the top score
    assert column(risk.explore_alerts(flagged, ["geo_jump", "high_z"], " ROME "), "txn_id") == [2]
    assert column(risk.explore_alerts(flagged, min_amount=5.0), "txn_id") == [1]
    assert {r.reason: r.n for r in risk.alert_reason_counts(flagged).collect()} == dict.fromkeys(risk.RULES, 1)


def test_evaluation(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "true string, pred string")
    report = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in evaluate.class_report(pairs).collect()}
    assert report == {"a": (1.0, 0.5, 2 / 3, 2), "b": (0.5, 0.5, 0.5, 2), "c": (0.0, 0.0, 0.0, 0)}
    assert [tuple(r) for r in evaluate.confusion(pairs).collect()] == [("a", "a", 1), ("a", "b", 1), ("b", "a", 0), ("b", "b", 1)]
    scores = evaluate.f1_scores(pairs).first()
    assert scores.macro_f1 == pytest.approx((2 / 3 + 0.5) / 3) and scores.weighted_f1 == pytest.approx((2 / 3 + 0.5) / 2)


def test_empty_facts_keep_their_schema(spark):
    empty = make(spark, [("2024-01-01", "a", 1.0, "c")]).limit(0)
    budgets = spark.createDataFrame([("c", 1.0)], "category string, budget double")
    for found in (
        insights.category_spend(empty), insights.spend_series(empty), insights.top_merchants(empty), insights.high_spend_z(empty),
        visits.recurring_charges(empty), visits.merchants_due(empty, "2024-01-01"), forecast.projection_change(empty),
        forecast.growing_categories(empty), affinity.merchant_category_affinity(empty, ["c"]), patterns.dow_average(empty),
    ):
        assert found.columns and found.count() == 0
    assert column(patterns.time_of_day(empty), "n") == [0] * 4
    assert insights.kpi_summary(empty).first().transactions == 0
    assert patterns.spending_trend(empty).first().spending_trend == "stable"
    assert profile.profile_duplicates(empty).first()[0] == 0
    assert {r.category: r.actual for r in budget.budget_vs_actual(empty, budgets).collect()} == {"c": 0.0, "TOTAL": 0.0}
    assert features.amount_bin(empty).count() == 0
    assert cleaning.drop_report(empty).first().rows_in == 0


def test_time_shapes(spark):
    shapes = {
        "2024/01/05": "2024-01-05 00:00:00",
        "01/02/2024 3:45 PM": "2024-01-02 15:45:00",
        "2024-01-01T10:00:00Z": "2024-01-01 10:00:00",
        "2024-01-05 10:00:00+02:00": "2024-01-05 08:00:00",
        "Jan 5, 2024": "2024-01-05 00:00:00",
        "01/02/24": "2024-01-02 00:00:00",
        "20240105": "2024-01-05 00:00:00",
        "2024-01-05 10": "2024-01-05 10:00:00",
        "12345678": None,
        "not a date": None,
    }
    df = spark.createDataFrame([(x,) for x in shapes], "x string")
    found = {r.x: r.t for r in df.select("x", timestamp_from_text(F.col("x")).cast("string").alias("t")).collect()}
    assert found == shapes


def test_align_batch_moves_a_column_in_the_way(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0, "a", "b")], "date string, amt double, description string, merchant string")
    assert align_batch(df).columns == ["timestamp", "amount", "merchant", "other_merchant"]
