"""Queries on summaries, series, patterns, forecasts, budgets and profile."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalog.registry import longs, query, r, rounded
from catalog.views import (
    EVENTS_SQL,
    LINEITEM_SQL,
    ORDERS_SQL,
    event_facts,
    events,
    forest_sql,
    lineitem_facts,
    order_facts,
    table,
)
from ledgerline.functions.times import epoch_micros
from ledgerline.operators import (
    affinity,
    anomalies,
    budget,
    evaluate,
    features,
    forecast,
    forest,
    insights,
    patterns,
    profile,
    risk,
    sampling,
    visits,
)
from ledgerline.operators.categorizer import term_statistics

EV = "WITH " + EVENTS_SQL
OR = "WITH " + ORDERS_SQL
LI = "WITH " + LINEITEM_SQL


# ------------------------------------------------------------------ summaries


@query(
    "category_spend",
    f"{EV} SELECT pred_category AS category, {r('sum(amount)')} AS total_spend FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def category_spend(spark, sf):
    return rounded(insights.category_spend(event_facts(spark, sf)), total_spend=4)


@query("category_counts", f"{EV} SELECT pred_category AS category, count(*) AS n FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def category_counts(spark, sf):
    return insights.category_counts(event_facts(spark, sf))


@query(
    "kpi_summary",
    f"""{EV} SELECT {r('sum(amount)')} AS total_spend, count(*) AS transactions, {r('avg(amount)')} AS avg_ticket,
    count(DISTINCT merchant) AS unique_merchants, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS BIGINT) AS days_tracked FROM f""",
)
def kpi_summary(spark, sf):
    return rounded(insights.kpi_summary(event_facts(spark, sf)), total_spend=4, avg_ticket=4)


@query("category_accuracy", f"{EV} SELECT {r('avg(CASE WHEN pred_category = category THEN 1.0 ELSE 0.0 END)', 6)} AS agreement FROM f")
def category_accuracy(spark, sf):
    return rounded(insights.category_accuracy(event_facts(spark, sf)), agreement=6)


def _series_sql(view: str, start: str, label: str, step: str) -> str:
    return f"""{view}, b AS (
      SELECT CAST({start} AS DATE) AS b, sum(amount) AS t, count(*) AS c, avg(amount) AS m FROM f GROUP BY 1),
    cal AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(b) FROM b) AS TIMESTAMP), CAST((SELECT max(b) FROM b) AS TIMESTAMP), INTERVAL {step})) AS DATE) AS b)
    SELECT CAST({label} AS VARCHAR) AS bucket, {r('coalesce(t, 0)')} AS total, CAST(coalesce(c, 0) AS BIGINT) AS n, {r('m')} AS mean
    FROM cal LEFT JOIN b USING (b)"""


def _series(facts, every):
    series = insights.spend_series(facts, every).withColumn("bucket", F.col("bucket").cast("string"))
    return rounded(series, total=4, mean=4)


@query("spend_daily", _series_sql(EV, "ts", "cal.b", "1 DAY"))
def spend_daily(spark, sf):
    return _series(event_facts(spark, sf), "day")


@query("spend_weekly", _series_sql(EV, "date_trunc('week', ts)", "cal.b + 6", "7 DAY"))
def spend_weekly(spark, sf):
    return _series(event_facts(spark, sf), "week")


@query("spend_monthly", _series_sql(OR, "date_trunc('month', ts)", "last_day(cal.b)", "1 MONTH"))
def spend_monthly(spark, sf):
    return _series(order_facts(spark, sf), "month")


TOP_SQL = f"SELECT merchant, {r('sum(amount)')} AS total_spend, count(*) AS transactions FROM f"


@query("top_merchants", f"{EV} {TOP_SQL} GROUP BY 1 ORDER BY sum(amount) DESC, 1 LIMIT 15")
def top_merchants(spark, sf):
    return rounded(insights.top_merchants(event_facts(spark, sf)), total_spend=4)


@query("top_merchants_filtered", f"{EV} {TOP_SQL} WHERE pred_category = 'purchase' GROUP BY 1 ORDER BY sum(amount) DESC, 1 LIMIT 15")
def top_merchants_filtered(spark, sf):
    return rounded(insights.top_merchants(event_facts(spark, sf), category="purchase"), total_spend=4)


@query(
    "high_spend_z",
    f"""{EV}, s AS (SELECT pred_category, avg(amount) AS m, stddev_samp(amount) AS sd FROM f GROUP BY 1)
    SELECT txn_id, pred_category AS category, amount, {r('(amount - m) / nullif(sd, 0)', 6)} AS z
    FROM f JOIN s USING (pred_category) WHERE sd > 0 ORDER BY (amount - m) / sd DESC, txn_id LIMIT 10""",
)
def high_spend_z(spark, sf):
    top = insights.high_spend_z(event_facts(spark, sf), top_n=10)
    return rounded(top.select("txn_id", F.col("pred_category").alias("category"), "amount", "z"), z=6)


# ------------------------------------------------------------------ patterns


@query(
    "weekend_ratio",
    f"""{EV} SELECT {r('avg(CASE WHEN isodow(ts) >= 6 THEN amount END) / (avg(CASE WHEN isodow(ts) < 6 THEN amount END) + 0.01)', 6)}
    AS weekend_vs_weekday_ratio FROM f""",
)
def weekend_ratio(spark, sf):
    return rounded(patterns.weekend_ratio(event_facts(spark, sf)), weekend_vs_weekday_ratio=6)


@query(
    "dow_average",
    f"{EV} SELECT CAST(isodow(ts) - 1 AS BIGINT) AS ordinal, dayname(ts) AS day, {r('avg(amount)')} AS avg_amount FROM f GROUP BY 1, 2",
)
def dow_average(spark, sf):
    return longs(rounded(patterns.dow_average(event_facts(spark, sf)), avg_amount=4), "ordinal")


@query(
    "time_of_day",
    f"""{EV}, p AS (SELECT * FROM (VALUES (0, 'Night', 0, 6), (1, 'Morning', 7, 12), (2, 'Afternoon', 13, 18), (3, 'Evening', 19, 23)) t(o, period, lo, hi))
    SELECT CAST(o AS BIGINT) AS ordinal, period, {r('coalesce(sum(amount), 0)')} AS total, count(amount) AS n
    FROM p LEFT JOIN f ON hour(ts) BETWEEN lo AND hi GROUP BY 1, 2""",
)
def time_of_day(spark, sf):
    return longs(rounded(patterns.time_of_day(event_facts(spark, sf)), total=4), "ordinal")


@query(
    "merchant_entropy",
    f"""{EV}, c AS (SELECT count(*) * 1.0::DOUBLE / (SELECT count(*) FROM f) AS p FROM f GROUP BY merchant)
    SELECT {r('-sum(p * ln(p))', 6)} AS merchant_diversity_score FROM c""",
)
def merchant_entropy(spark, sf):
    return rounded(patterns.merchant_entropy(event_facts(spark, sf)), merchant_diversity_score=6)


@query(
    "spending_trend",
    f"""{OR}, w AS (SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM f)) // 86400000000 // 7 AS week, sum(amount) AS t FROM f GROUP BY 1),
    q AS (SELECT *, row_number() OVER (ORDER BY week) AS a, row_number() OVER (ORDER BY week DESC) AS b FROM w),
    s AS (SELECT count(*) AS weeks, avg(CASE WHEN a <= 3 THEN t END) AS fm, avg(CASE WHEN b <= 3 THEN t END) AS lm FROM q)
    SELECT weeks, {r('fm')} AS first_mean, {r('lm')} AS last_mean,
    CASE WHEN weeks <= 2 THEN 'stable' WHEN lm > fm THEN 'increasing' ELSE 'decreasing' END AS spending_trend FROM s""",
)
def spending_trend(spark, sf):
    return rounded(patterns.spending_trend(order_facts(spark, sf)), first_mean=4, last_mean=4)


# ------------------------------------------------------------------ forecasts

MONTHS = f"{OR}, m AS (SELECT month, sum(amount) AS t, row_number() OVER (ORDER BY month DESC) AS age FROM f GROUP BY 1)"


@query("projected_next_month", f"{MONTHS} SELECT {r('avg(t)')} AS projected_next_month FROM m WHERE age <= 3")
def projected_next_month(spark, sf):
    return rounded(forecast.projected_next_month(order_facts(spark, sf)), projected_next_month=4)


@query(
    "projection_change",
    f"""{MONTHS}, p AS (SELECT avg(t) AS pr, max(CASE WHEN age = 1 THEN t END) AS cu FROM m WHERE age <= 3)
    SELECT {r('pr')} AS projected_next_month, {r('cu')} AS current_month, {r('CASE WHEN cu > 0 THEN (pr - cu) / cu * 100 ELSE 0 END')} AS change_pct FROM p""",
)
def projection_change(spark, sf):
    change = forecast.projection_change(order_facts(spark, sf))
    return rounded(change, projected_next_month=4, current_month=4, change_pct=4)


@query(
    "growing_categories",
    f"""{OR}, m AS (SELECT pred_category AS category, month, sum(amount) AS t FROM f GROUP BY 1, 2),
    a AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY month DESC) AS age FROM m)
    SELECT category FROM a GROUP BY 1 HAVING max(CASE WHEN age = 1 THEN t END) > max(CASE WHEN age = 3 THEN t END)""",
)
def growing_categories(spark, sf):
    return forecast.growing_categories(order_facts(spark, sf))


@query(
    "merchants_due",
    f"""{OR}, top AS (SELECT merchant, count(*) AS n FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
    v AS (SELECT merchant, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY merchant ORDER BY ts)) // 86400000000 AS gap FROM f JOIN top USING (merchant)),
    s AS (SELECT merchant, count(*) AS n, avg(gap) AS ai, (epoch_us(TIMESTAMP '2001-09-01') - max(epoch_us(ts))) // 86400000000 AS ds FROM v GROUP BY 1)
    SELECT merchant, {r('ai')} AS avg_interval_days, CAST(ds AS BIGINT) AS days_since_last FROM s
    WHERE n >= 3 AND ds >= ai * 0.8 ORDER BY n DESC, merchant LIMIT 5""",
)
def merchants_due(spark, sf):
    return rounded(visits.merchants_due(order_facts(spark, sf), "2001-09-01"), avg_interval_days=4)


@query(
    "recurring_charges",
    f"""{LI}, v AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY merchant ORDER BY ts)) // 86400000000 AS gap FROM f),
    s AS (SELECT merchant, count(*) AS n, median(gap) AS md, stddev_samp(amount) / avg(amount) AS cv, max(ts) AS last FROM v GROUP BY 1)
    SELECT merchant, n, CAST(md AS DOUBLE) AS median_interval_days, {r('cv', 6)} AS amount_cv, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_seen,
    strftime(last + to_hours(CAST(md * 24 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS next_estimated FROM s WHERE n >= 3 AND md BETWEEN 26 AND 33 AND cv < 0.2""",
)
def recurring_charges(spark, sf):
    found = rounded(visits.recurring_charges(lineitem_facts(spark, sf)), amount_cv=6)
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("last_seen", "next_estimated")})


CATEGORIES = ["click", "error", "purchase", "signup", "view"]


@query(
    "merchant_category_affinity",
    f"""{EV}, top AS (SELECT merchant FROM f GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
    SELECT merchant, {', '.join(r(f"coalesce(sum(CASE WHEN pred_category = '{c}' THEN amount END), 0)") + f' AS "{c}"' for c in CATEGORIES)}
    FROM f JOIN top USING (merchant) GROUP BY 1""",
)
def merchant_category_affinity(spark, sf):
    return rounded(affinity.merchant_category_affinity(event_facts(spark, sf)), **dict.fromkeys(CATEGORIES, 4))


# ------------------------------------------------------------------ budgets

LAST = "l AS (SELECT * FROM f WHERE month = (SELECT max(month) FROM f))"


def _budgets(facts):
    """A budget per category from its usual month; one is 0, to show that case."""
    usual = facts.groupBy(F.col("pred_category").alias("category")).agg(
        F.round(F.sum("amount") / F.count_distinct("month"), 0).alias("budget")
    )
    return usual.withColumn("budget", F.when(F.col("category").startswith("5"), F.lit(0.0)).otherwise(F.col("budget")))


@query(
    "budget_vs_actual",
    f"""{OR}, {LAST}, b AS (SELECT pred_category AS category, CASE WHEN pred_category LIKE '5%' THEN 0.0::DOUBLE ELSE round(sum(amount) / count(DISTINCT month), 0) END AS budget FROM f GROUP BY 1),
    t AS (SELECT pred_category AS category, sum(amount) AS actual FROM l GROUP BY 1),
    x AS (SELECT category, budget, coalesce(actual, 0) AS actual, 0 AS tot FROM b LEFT JOIN t USING (category)),
    y AS (SELECT * FROM x UNION ALL SELECT 'TOTAL', sum(budget), sum(actual), 1 FROM x),
    u AS (SELECT *, CASE WHEN budget > 0 THEN actual / budget * 100 ELSE 0.0::DOUBLE END AS p FROM y)
    SELECT category, {r('budget')} AS budget, {r('actual')} AS actual, {r('budget - actual')} AS variance, {r('p')} AS pct_used,
    CASE WHEN tot = 1 THEN NULL WHEN p < 80 THEN 'green' WHEN p < 100 THEN 'orange' ELSE 'red' END AS status FROM u""",
)
def budget_vs_actual(spark, sf):
    facts = order_facts(spark, sf)
    lines = budget.budget_vs_actual(facts, _budgets(facts))
    return rounded(lines, budget=4, actual=4, variance=4, pct_used=4)


@query(
    "budget_default_categories",
    f"{OR}, {LAST} SELECT pred_category AS category, {r('sum(amount)')} AS total_spend FROM l GROUP BY 1 ORDER BY sum(amount) DESC, 1 LIMIT 5",
)
def budget_default_categories(spark, sf):
    return rounded(budget.budget_default_categories(order_facts(spark, sf)), total_spend=4)


@query("months_present", f"{OR} SELECT DISTINCT month FROM f")
def months_present(spark, sf):
    return insights.values_present(order_facts(spark, sf), "month")


# ------------------------------------------------------------------ profile


EVENT_COLUMNS = ["txn_id", "timestamp", "cc_num", "category", "amount", "k", "merchant", "city", "state", "code"]
LINEITEM_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


@query(
    "profile_nulls",
    f"""{EV}, v AS (SELECT txn_id, ts AS timestamp, cc_num, category, amount, k, merchant_raw AS merchant, city, state, CASE WHEN k % 17 <> 0 THEN k END AS code FROM f)
    SELECT count(*) AS rows, {", ".join(f"count(*) - count({c}) AS null_{c}" for c in EVENT_COLUMNS)}, count(DISTINCT category) AS labels,
    count(CASE WHEN amount <= 0 THEN 1 END) AS nonpositive_amounts FROM v""",
)
def profile_nulls(spark, sf):
    return profile.profile_nulls(events(spark, sf).withColumn("code", F.when(F.col("k") % 17 != 0, F.col("k"))))


@query(
    "profile_duplicates",
    """WITH v AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 7 = 0), g AS (SELECT count(*) AS c FROM v GROUP BY {})
    SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM g""".format(", ".join(LINEITEM_COLUMNS)),
)
def profile_duplicates(spark, sf):
    """Whole rows of all columns; a seventh of the orders stand in the table twice."""
    rows = table(spark, sf, "lineitem")
    return profile.profile_duplicates(rows.unionByName(rows.where(F.col("l_orderkey") % 7 == 0)))


@query("profile_labels", f"{EV} SELECT CASE WHEN k % 17 <> 0 THEN category END AS label, count(*) AS n FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def profile_labels(spark, sf):
    label = F.when(F.col("k") % 17 != 0, F.col("category"))
    return profile.profile_labels(events(spark, sf).withColumn("category", label))


@query(
    "profile_amount",
    f"""SELECT count(o_totalprice) AS n, {r('avg(o_totalprice)')} AS mean, {r('stddev_samp(o_totalprice)')} AS std, {r('min(o_totalprice)')} AS min,
    {r('quantile_cont(o_totalprice, 0.25)')} AS q25, {r('quantile_cont(o_totalprice, 0.5)')} AS median, {r('quantile_cont(o_totalprice, 0.75)')} AS q75, {r('max(o_totalprice)')} AS max FROM orders""",
)
def profile_amount(spark, sf):
    figures = profile.profile_amount(order_facts(spark, sf))
    return rounded(figures, mean=4, std=4, min=4, q25=4, median=4, q75=4, max=4)


# ------------------------------------------------------------------ evaluation and sampling


def _evaluated(spark, sf):
    return event_facts(spark, sf).withColumnsRenamed({"category": "true", "pred_category": "pred"})


LABELS = "lab AS (SELECT DISTINCT category AS label FROM f)"
REPORT = f"""{EV}, c AS (SELECT label, count(CASE WHEN category = label THEN 1 END) AS support, count(CASE WHEN pred_category = label THEN 1 END) AS predicted,
  count(CASE WHEN category = label AND pred_category = label THEN 1 END) AS hits FROM f, (SELECT category AS label FROM f UNION SELECT pred_category FROM f) GROUP BY label),
  rep AS (SELECT label AS class, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
  2.0::DOUBLE * hits / (support + predicted) AS f1, support FROM c)"""


@query(
    "eval_confusion",
    f"""{EV}, {LABELS}, p AS (SELECT category AS t, pred_category AS q, count(*) AS c FROM f GROUP BY 1, 2)
    SELECT a.label AS "true", b.label AS pred, CAST(coalesce(c, 0) AS BIGINT) AS n FROM lab a CROSS JOIN lab b LEFT JOIN p ON t = a.label AND q = b.label""",
)
def eval_confusion(spark, sf):
    return evaluate.confusion(_evaluated(spark, sf))


@query("eval_class_report", f"{REPORT} SELECT class, {r('precision', 6)} AS precision, {r('recall', 6)} AS recall, {r('f1', 6)} AS f1, support FROM rep")
def eval_class_report(spark, sf):
    return rounded(evaluate.class_report(_evaluated(spark, sf)), precision=6, recall=6, f1=6)


@query("eval_f1", f"{REPORT} SELECT {r('avg(f1)', 6)} AS macro_f1, {r('sum(f1 * support) / sum(support)', 6)} AS weighted_f1 FROM rep")
def eval_f1(spark, sf):
    return rounded(evaluate.f1_scores(_evaluated(spark, sf)), macro_f1=6, weighted_f1=6)


@query(
    "prediction_sample",
    f"""{EV} SELECT txn_id, merchant, amount, epoch_us(ts) AS micros, category AS "true", pred_category AS pred FROM f ORDER BY txn_id LIMIT 200""",
)
def prediction_sample(spark, sf):
    sample = evaluate.prediction_sample(_evaluated(spark, sf))
    return sample.withColumn("timestamp", epoch_micros(F.col("timestamp"))).withColumnRenamed("timestamp", "micros")


def _quota_sql(size: str) -> str:
    return f"""c AS (SELECT pred_category AS label, count(*) AS n FROM f GROUP BY 1),
    t AS (SELECT *, {size} AS want, (SELECT count(*) FROM f) AS total FROM c),
    b AS (SELECT *, want * n // total AS base, want * n % total AS rest FROM t),
    q AS (SELECT label, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b)"""


@query("stratified_sample", f"{EV}, {_quota_sql('(SELECT count(*) // 3 FROM f)')} SELECT label, CAST(quota AS BIGINT) AS n FROM q WHERE quota > 0")
def stratified_sample(spark, sf):
    facts = event_facts(spark, sf)
    sample = sampling.stratified_sample(facts, "pred_category", facts.count() // 3)
    return sample.groupBy(F.col("pred_category").alias("label")).agg(F.count("*").alias("n"))


@query(
    "stratified_split",
    f"""{EV}, {_quota_sql('(SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) FROM f)')}
    SELECT label, 'test' AS split, CAST(quota AS BIGINT) AS n FROM q UNION ALL SELECT label, 'train', CAST(n - quota AS BIGINT) FROM q""",
)
def stratified_split(spark, sf):
    split = sampling.stratified_split(event_facts(spark, sf), "pred_category")
    return split.groupBy(F.col("pred_category").alias("label"), "split").agg(F.count("*").alias("n"))


@query(
    "class_weights",
    f"""{EV}, c AS (SELECT pred_category AS category, count(*) AS n FROM f GROUP BY 1)
    SELECT category, n, {r('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)', 6)} AS weight FROM c""",
)
def class_weights(spark, sf):
    weights = sampling.class_weights(event_facts(spark, sf), "pred_category")
    return rounded(weights.withColumnRenamed("pred_category", "category"), weight=6)


@query(
    "tfidf_terms",
    f"""WITH t AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '\\b\\w\\w+\\b')) AS term FROM part),
    c AS (SELECT term, count(DISTINCT p_partkey) AS df, count(*) AS tf FROM t GROUP BY 1)
    SELECT term, df, {r('ln((1 + (SELECT count(*) FROM part)) / (1 + df)::DOUBLE) + 1', 6)} AS idf FROM c WHERE df >= 3 ORDER BY tf DESC, term LIMIT 10000""",
)
def tfidf_terms(spark, sf):
    return rounded(term_statistics(table(spark, sf, "part"), "p_name"), idf=6)


# ------------------------------------------------------------------ anomalies

ANOMALY = f"""{EV}, a AS (SELECT *, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, day(ts) AS day_of_month, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  ln(1 + amount) AS log_amount, count(*) OVER (PARTITION BY merchant) AS merchant_freq, count(*) OVER (PARTITION BY d) AS daily_txn_count,
  amount / (median(amount) OVER (PARTITION BY pred_category) + 1) AS amount_vs_category_median FROM f),
  lim AS (SELECT quantile_cont(amount, 0.95) AS hi FROM f), days AS (SELECT d, count(*) AS c FROM f GROUP BY 1), busy AS (SELECT quantile_cont(c, 0.9) AS bd FROM days),
  w AS (SELECT *, concat_ws(',', CASE WHEN merchant_freq <= 3 THEN 'rare_merchant' END, CASE WHEN amount > hi THEN 'high_amount' END,
  CASE WHEN daily_txn_count > bd THEN 'high_frequency_day' END, CASE WHEN hour < 6 THEN 'unusual_hour' END) AS hit FROM a, lim, busy),
  why AS (SELECT *, CASE WHEN hit = '' THEN 'pattern_based' ELSE hit END AS reasons FROM w)"""


@query(
    "anomaly_features",
    f"""{ANOMALY} SELECT txn_id, CAST(hour AS BIGINT) AS hour, CAST(day_of_week AS BIGINT) AS day_of_week, CAST(day_of_month AS BIGINT) AS day_of_month,
    CAST(is_weekend AS BIGINT) AS is_weekend, amount, {r('log_amount', 6)} AS log_amount, merchant_freq, CAST(CASE WHEN merchant_freq <= 3 THEN 1 ELSE 0 END AS BIGINT) AS is_rare_merchant,
    {r('amount_vs_category_median', 6)} AS amount_vs_category_median, daily_txn_count FROM a""",
)
def anomaly_features(spark, sf):
    found = anomalies.anomaly_features(event_facts(spark, sf)).select("txn_id", *anomalies.ANOMALY_FEATURES)
    whole = ["hour", "day_of_week", "day_of_month", "is_weekend", "is_rare_merchant"]
    return longs(rounded(found, log_amount=6, amount_vs_category_median=6), *whole)


def _reasons(spark, sf):
    facts = event_facts(spark, sf)
    return anomalies.anomaly_reasons(anomalies.anomaly_features(facts), facts)


@query("anomaly_reasons", f"{ANOMALY} SELECT txn_id, reasons FROM why")
def anomaly_reasons(spark, sf):
    return _reasons(spark, sf).select("txn_id", F.array_join("reasons", ",").alias("reasons"))


@query("anomaly_reason_counts", f"{ANOMALY}, e AS (SELECT unnest(string_split(reasons, ',')) AS reason FROM why) SELECT reason, count(*) AS n FROM e GROUP BY 1")
def anomaly_reason_counts(spark, sf):
    return risk.reason_counts(_reasons(spark, sf))


@query("anomaly_daily", f"{ANOMALY} SELECT CAST(d AS VARCHAR) AS date, count(*) AS n FROM why WHERE reasons <> 'pattern_based' GROUP BY 1")
def anomaly_daily(spark, sf):
    marked = _reasons(spark, sf).where(~F.array_contains("reasons", "pattern_based"))
    return anomalies.anomaly_daily(marked).withColumn("date", F.col("date").cast("string"))


# A fixed forest of three trees over the anomaly features: tree, node, feature, threshold, left, right, path.
FOUND_NODES = [
    (0, 0, 4, 85.50013, 1, 2, 0.0), (0, 1, 0, 4.5, 3, 4, 0.0), (0, 2, 6, 40.5, 5, 6, 0.0), (0, 3, -1, 1e300, 3, 3, 5.0), (0, 4, -1, 1e300, 4, 4, 9.0),
    (0, 5, -1, 1e300, 5, 5, 2.5), (0, 6, -1, 1e300, 6, 6, 6.0),
    (1, 0, 8, 1.70009, 1, 2, 0.0), (1, 1, -1, 1e300, 1, 1, 8.5), (1, 2, 3, 0.5, 3, 4, 0.0), (1, 3, -1, 1e300, 3, 3, 5.5), (1, 4, -1, 1e300, 4, 4, 3.0),
    (2, 0, 7, 0.5, 1, 2, 0.0), (2, 1, 1, 4.5, 3, 4, 0.0), (2, 2, -1, 1e300, 2, 2, 2.0), (2, 3, -1, 1e300, 3, 3, 9.5), (2, 4, -1, 1e300, 4, 4, 7.0),
]
FOUND_FOREST = forest.IsolationForestModel(
    anomalies.ANOMALY_FEATURES, 256, 2, -0.6, pd.DataFrame(FOUND_NODES, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])
)
FOUND_SQL = (
    f"{ANOMALY}, rare AS (SELECT *, CAST(merchant_freq <= 3 AS INT) AS is_rare_merchant FROM why)"
    + forest_sql("rare", anomalies.ANOMALY_FEATURES, FOUND_NODES, 2, 256, -0.6)
)


def _found(spark, sf):
    """The anomalies that the fixed forest finds, with their reasons."""
    return FOUND_FOREST.decide(FOUND_FOREST.score_in_joins(_reasons(spark, sf))).where("is_anomaly")


@query(
    "found_anomaly_reasons",
    f"{FOUND_SQL}, e AS (SELECT unnest(string_split(reasons, ',')) AS reason FROM found WHERE forest_decision < 0) SELECT reason, count(*) AS n FROM e GROUP BY 1",
)
def found_anomaly_reasons(spark, sf):
    return risk.reason_counts(_found(spark, sf))


@query("found_anomaly_daily", f"{FOUND_SQL} SELECT CAST(d AS VARCHAR) AS date, count(*) AS n FROM found WHERE forest_decision < 0 GROUP BY 1")
def found_anomaly_daily(spark, sf):
    return anomalies.anomaly_daily(_found(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query("multi_dim_anomalies")
def multi_dim_anomalies(spark, sf):
    found = anomalies.multi_dim_anomalies(event_facts(spark, sf))
    return found.withColumn("reasons", F.array_join("reasons", ","))


# ------------------------------------------------------------------ row features


@query(
    "calendar_features",
    f"""{EV} SELECT txn_id, CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, CAST(day(ts) AS BIGINT) AS day_of_month,
    CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend FROM f""",
)
def calendar_features(spark, sf):
    names = ["hour", "day_of_week", "day_of_month", "is_weekend"]
    return longs(features.calendar_features(events(spark, sf)).select("txn_id", *names), *names)


@query(
    "facts_calendar",
    f"""{EV} SELECT txn_id, CAST(d AS VARCHAR) AS date, strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
    strftime(ts, '%Y-%m') AS month FROM f""",
)
def facts_calendar(spark, sf):
    return event_facts(spark, sf).select("txn_id", F.col("date").cast("string").alias("date"), "week", "month")


@query("log_amount", f"{EV} SELECT txn_id, {r('CASE WHEN amount > -1 THEN ln(1 + amount) END', 6)} AS log_amount FROM f")
def log_amount(spark, sf):
    built = features.model_features(events(spark, sf), bins="fixed")
    return rounded(built.select("txn_id", "log_amount"), log_amount=6)


def _bins(spark, sf, **options):
    return longs(features.amount_bin(events(spark, sf), **options).select("txn_id", "amount_bin"), "amount_bin")


def _bin_sql(q: int) -> str:
    edges = ", ".join(f"quantile_cont(amount, {i / q}) AS e{i}" for i in range(q + 1))
    inner = " + ".join(f"CASE WHEN e{i} > e0 AND e{i} < e{q} AND e{i} > e{i - 1} AND amount > e{i} THEN 1 ELSE 0 END" for i in range(1, q))
    return f"{EV}, e AS (SELECT {edges} FROM f) SELECT txn_id, CAST(CASE WHEN e0 < e{q} THEN {inner} END AS BIGINT) AS amount_bin FROM f, e"


@query("amount_bin_q4", _bin_sql(4))
def amount_bin_q4(spark, sf):
    return _bins(spark, sf, q=4)


@query("amount_bin_q5", _bin_sql(5))
def amount_bin_q5(spark, sf):
    return _bins(spark, sf, q=5)


@query("amount_bin_fixed", f"{EV} SELECT txn_id, CAST(CASE WHEN amount <= 10 THEN 0 WHEN amount <= 50 THEN 1 WHEN amount <= 200 THEN 2 ELSE 3 END AS BIGINT) AS amount_bin FROM f")
def amount_bin_fixed(spark, sf):
    return _bins(spark, sf, bins="fixed")


@query(
    "amount_bin_edges",
    f"{EV} SELECT txn_id, CAST(CASE WHEN amount < 5 OR amount > 150 THEN NULL WHEN amount <= 20 THEN 0 WHEN amount <= 60 THEN 1 ELSE 2 END AS BIGINT) AS amount_bin FROM f",
)
def amount_bin_edges(spark, sf):
    return _bins(spark, sf, edges=[5.0, 20.0, 60.0, 150.0])
