"""The driver tables as transactions, in Spark and as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.cleaning import clean
from ledgerline.operators.facts import make_facts
from ledgerline.operators.forest import mean_path

# ------------------------------------------------------------------ tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uncleaned transactions: 150 cards per 10,000 rows, times to the microsecond."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    user = F.col("user_id").cast("string")
    merchant = F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("Kiosk "), k, F.lit("-"), user)).otherwise(
        F.concat(F.lit("Store #"), k, F.lit(" & Co."))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("txn_id"),
        F.col("ts").alias("timestamp"),
        F.col("user_id").alias("cc_num"),
        F.col("event_type").alias("category"),
        F.col("value").alias("amount"),
        k.cast("int").alias("k"),
        merchant.alias("merchant"),
        F.concat(F.lit("City "), (F.col("user_id") % 7).cast("string")).alias("city"),
        F.concat(F.lit("State "), (F.col("user_id") % 5).cast("string")).alias("state"),
    )


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the events, with a stand-in prediction that SQL can repeat."""
    predicted = F.when(F.col("k") % 10 == 0, F.lit("view")).otherwise(F.col("category"))
    return make_facts(clean(events(spark, sf_dir)).withColumn("pred_category", predicted))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions over 80 months; the merchant is the customer's nation."""
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return make_facts(
        joined.select(
            F.col("o_orderkey").alias("txn_id"),
            F.col("o_orderdate").alias("timestamp"),
            F.col("o_custkey").alias("cc_num"),
            F.col("n_name").alias("merchant"),
            F.col("o_orderpriority").alias("pred_category"),
            F.col("o_totalprice").alias("amount"),
        )
    )


def lineitem_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as charges by brand and size."""
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return make_facts(
        joined.select(
            F.col("l_shipdate").alias("timestamp"),
            F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("merchant"),
            F.col("p_retailprice").alias("amount"),
        )
    )


def raw_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under raw card-file headers, with coordinates of which some are missing."""
    card, k = F.col("cc_num"), F.col("k")
    lat, long = (card % 20).cast("double") + 20.0, (card % 30).cast("double") - 15.0
    return events(spark, sf_dir).select(
        "txn_id",
        F.col("timestamp").alias("trans_date_trans_time"),
        "merchant",
        "category",
        F.col("amount").alias("amt"),
        "city",
        "state",
        "cc_num",
        lat.alias("lat"),
        long.alias("long"),
        (lat + (k - 50) / F.lit(10.0)).alias("merch_lat"),
        F.when(k % 17 != 0, long + (k % 13 - 6) * F.lit(1.5)).alias("merch_long"),
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text with raw headers; each 20th row has the same kind of flaw."""
    flaw = F.col("txn_id") % 20
    money = F.concat(F.lit("$"), F.format_number(F.col("amount") * 1000 + 1000, 2))
    amt = (
        F.when(flaw == 1, money)
        .when(flaw == 2, F.lit("abc"))
        .when(flaw == 3, F.lit(""))
        .when(flaw == 7, F.lit("inf"))
        .otherwise(F.col("amount").cast("string"))
    )
    day_first = F.date_format(F.col("timestamp"), "dd/MM/yyyy HH:mm:ss")
    time = (
        F.when(flaw == 4, F.lit("not a date"))
        .when(flaw == 5, day_first)
        .otherwise(F.col("timestamp").cast("string"))
    )
    return events(spark, sf_dir).select(
        F.col("txn_id").cast("string").alias("Unnamed: 0"),
        time.alias("trans_date_trans_time"),
        F.col("cc_num").cast("string").alias("cc_num"),
        F.when(flaw != 6, F.col("merchant")).alias("merchant"),
        "category",
        amt.alias("amt"),
        "city",
        "state",
    )


def write_lines(lines: DataFrame, heading: list[str], path: str) -> None:
    """Write text ``lines`` (value), each file with the ``heading`` lines above its own; a file for each partition."""

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(heading, pa.string())], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    lines.select("value").mapInArrow(headed, "value string").write.text(path)


# ------------------------------------------------------------------ the same as SQL

EVENTS_SQL = """
ev AS (
  SELECT event_id AS txn_id, ts, user_id AS cc_num, event_type AS category, value AS amount,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CASE WHEN user_id % 10 = 0
              THEN 'Kiosk ' || regexp_extract(props, '([0-9]+)', 1) || '-' || CAST(user_id AS VARCHAR)
              ELSE 'Store #' || regexp_extract(props, '([0-9]+)', 1) || ' & Co.' END AS merchant_raw,
         'city ' || CAST(user_id % 7 AS VARCHAR) AS city,
         'state ' || CAST(user_id % 5 AS VARCHAR) AS state
  FROM events),
f AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(merchant_raw), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS merchant,
         CASE WHEN k % 10 = 0 THEN 'view' ELSE category END AS pred_category,
         CAST(ts AS DATE) AS d
  FROM ev)"""

ORDERS_SQL = """
f AS (
  SELECT o_orderkey AS txn_id, o_orderdate AS ts, o_custkey AS cc_num, n_name AS merchant,
         o_orderpriority AS pred_category, o_totalprice AS amount,
         CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m') AS month
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

LINEITEM_SQL = """
f AS (
  SELECT l_shipdate AS ts, p_brand || '-' || CAST(p_size AS VARCHAR) AS merchant, p_retailprice AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

RISK_SQL = (
    EVENTS_SQL
    + """,
g AS (
  SELECT f.*, (cc_num % 20) + 20.0::DOUBLE AS cust_lat, (cc_num % 30) - 15.0::DOUBLE AS cust_long,
         (cc_num % 20) + 20.0::DOUBLE + (k - 50) / 10.0::DOUBLE AS merch_lat,
         CASE WHEN k % 17 = 0 THEN NULL ELSE (cc_num % 30) - 15.0::DOUBLE + (k % 13 - 6) * 1.5::DOUBLE END AS merch_long
  FROM f),
h AS (
  SELECT *, CASE WHEN merch_long IS NULL THEN 1 ELSE 0 END AS geo_missing,
         CASE WHEN merch_long IS NULL THEN 0.0::DOUBLE ELSE
           2 * 6371.0088 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(merch_lat - cust_lat) / 2), 2)
           + cos(radians(cust_lat)) * cos(radians(merch_lat)) * pow(sin(radians(merch_long - cust_long) / 2), 2)))) END AS geo_dist_km,
         coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 60000000.0::DOUBLE, 1e6) AS prev_txn_delta_min,
         count(amount) OVER w20 AS roll_cnt_N, sum(amount) OVER w20 AS roll_sum_N, max(amount) OVER w20 AS roll_max_N,
         CASE WHEN count(amount) OVER w20 >= 5 THEN avg(amount) OVER w20 END AS roll_mean_N,
         CASE WHEN count(amount) OVER w20 >= 5 THEN stddev_samp(amount) OVER w20 END AS roll_std_N,
         row_number() OVER w AS card_visits,
         row_number() OVER (PARTITION BY cc_num, merchant ORDER BY ts, txn_id) AS visits,
         row_number() OVER (ORDER BY cc_num, ts, txn_id) AS pos
  FROM g
  WINDOW w AS (PARTITION BY cc_num ORDER BY ts, txn_id),
         w20 AS (PARTITION BY cc_num ORDER BY ts, txn_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
x AS (
  SELECT *, coalesce((amount - roll_mean_N) / nullif(roll_std_N, 0), 0) AS amount_z,
         (1 - pow(0.7, max(visits) OVER (PARTITION BY cc_num ORDER BY ts, txn_id ROWS UNBOUNDED PRECEDING)))
         / (1 - pow(0.7, card_visits)) AS merchant_conc_ewm,
         CASE WHEN amount < 5 AND prev_txn_delta_min < 10 THEN 1 ELSE 0 END AS repeat_small_charge,
         CASE WHEN prev_txn_delta_min < 2 THEN 1 ELSE 0 END AS rapid_swipes,
         CASE WHEN pos < 50 THEN 0 ELSE median(roll_sum_N) OVER (ORDER BY pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS long_baseline
  FROM h)"""
)


def flagged_sql(
    z_cut: float = 4.0, geo_km: float = 1000.0, vel_mul: float = 4.5, pct: float = 99.0, rules: int = 2,
    model: str = "", rows: str = "x", decision: str = "-amount_z",
) -> str:
    """Rules, score, threshold and alert flag. ``model`` holds more tables that give ``rows`` their ``decision``."""
    return (
        RISK_SQL
        + f"""{model},
y AS (
  SELECT *, concat_ws(',', CASE WHEN amount_z > {z_cut} THEN 'high_z' END,
                      CASE WHEN rapid_swipes = 1 THEN 'rapid_swipes' END,
                      CASE WHEN repeat_small_charge = 1 THEN 'repeat_small' END,
                      CASE WHEN geo_dist_km > {geo_km} THEN 'geo_jump' END,
                      CASE WHEN roll_sum_N > long_baseline * {vel_mul} THEN 'velocity_spike' END) AS reasons,
         CAST(amount_z > {z_cut} AS INT) + rapid_swipes + repeat_small_charge + CAST(geo_dist_km > {geo_km} AS INT)
         + CAST(roll_sum_N > long_baseline * {vel_mul} AS INT) AS hits,
         {decision} AS decision
  FROM {rows}),
s AS (
  SELECT *, (-decision - min(decision) OVER ()) / (max(decision) OVER () - min(decision) OVER () + 1e-9) AS risk_score FROM y),
a AS (
  SELECT *, quantile_cont(risk_score, {pct / 100.0}) OVER () AS threshold FROM s),
z AS (
  SELECT *, risk_score >= threshold OR hits >= {rules} AS is_alert FROM a)"""
    )


def forest_sql(rows: str, features: list[str], nodes: list[tuple], depth: int, sample_size: int, offset: float) -> str:
    """More tables: ``found`` holds ``rows`` with anomaly_score and forest_decision of a forest given by its nodes."""
    trees = len({node[0] for node in nodes})
    entries = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0)" for c in features)
    step = "SELECT c.txn_id, c.x, c.tree, CASE WHEN c.x[n.feature + 1] <= n.threshold THEN n.l ELSE n.r END AS node FROM c{} c JOIN nodes n USING (tree, node)"
    levels = "".join(f",\nc{k + 1} AS ({step.format(k)})" for k in range(depth))
    return f""",
nodes(tree, node, feature, threshold, l, r, path) AS (SELECT t, n, greatest(f, 0), h, a, b, p FROM (VALUES {", ".join(map(str, nodes))}) AS v(t, n, f, h, a, b, p)),
c0 AS (SELECT txn_id, [{entries}] AS x, tree, 0 AS node FROM {rows}, (SELECT DISTINCT tree FROM nodes)){levels},
scores AS (SELECT txn_id, pow(2, -sum(path) / ({trees} * {float(mean_path(sample_size))!r})) AS anomaly_score FROM c{depth} JOIN nodes USING (tree, node) GROUP BY 1),
found AS (SELECT {rows}.*, anomaly_score, -anomaly_score - ({offset}) AS forest_decision FROM {rows} JOIN scores USING (txn_id))"""
