"""Sequence features against a direct loop, with a hot card cut into many blocks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import order, risk, sequence

START = dt.datetime(2024, 1, 1)


def transactions(seed=7, n=1500, hot_share=0.5):
    rng = np.random.default_rng(seed)
    card = np.where(rng.random(n) < hot_share, 500, rng.integers(1, 60, n))
    minutes = np.cumsum(rng.integers(0, 30, n))
    return pd.DataFrame(
        {
            "txn_id": np.arange(n),
            "cc_num": card,
            "timestamp": [START + dt.timedelta(minutes=int(m)) for m in minutes],
            "merchant": [f"m{i}" for i in rng.integers(0, 12, n)],
            "amount": np.round(rng.gamma(1.0, 20.0, n), 2),
        }
    )


def by_loop(df):
    def one(card):
        card = card.copy()
        card["gap"] = card.timestamp.diff().dt.total_seconds().div(60).fillna(1e6)
        last = card.amount.rolling(20, min_periods=1)
        card["count"], card["sum"], card["max"] = last.count(), last.sum(), last.max()
        last = card.amount.rolling(20, min_periods=5)
        card["z"] = ((card.amount - last.mean()) / last.std().replace(0, np.nan)).fillna(0)
        weights, total, shares = {}, 0.0, []
        for merchant in card.merchant:
            total = 0.7 * total + 1
            weights[merchant] = 0.7 * weights.get(merchant, 0.0) + 1
            shares.append(max(weights.values()) / total)
        card["share"] = shares
        return card

    ordered = df.sort_values(["cc_num", "timestamp", "txn_id"])
    out = pd.concat([one(card) for _, card in ordered.groupby("cc_num")])
    out["baseline"] = out["sum"].rolling(200, min_periods=50).median().fillna(0)
    return out.set_index("txn_id")


NAMES = {
    "gap": "prev_txn_delta_min",
    "count": "roll_cnt_N",
    "sum": "roll_sum_N",
    "max": "roll_max_N",
    "z": "amount_z",
    "share": "merchant_conc_ewm",
    "baseline": "long_baseline",
}


@pytest.mark.parametrize("block", [219, 700, 10_000])
def test_matches_loop_whatever_the_blocks(spark, block):
    data = transactions()
    found = sequence.sequence_features(spark.createDataFrame(data), baseline=True, min_block=block).toPandas()
    expected = by_loop(data)
    assert len(found) == len(data)
    joined = expected.join(found.set_index("txn_id"), rsuffix="_found")
    for name, column in NAMES.items():
        np.testing.assert_allclose(joined[column].to_numpy(), joined[name].to_numpy(), rtol=1e-9, atol=1e-9, err_msg=name)


def test_blocks_share_the_hot_card_evenly(spark):
    data = spark.createDataFrame(transactions())
    ordered = order.order_rows(data, ["cc_num", "timestamp", "txn_id"], min_block=300)
    sizes = ordered.rows.groupBy("blk").count().toPandas()["count"]
    assert sizes.max() == 300 and len(sizes) == 5


def test_null_cards_are_dropped_and_reported(spark):
    rows = [(0, 1, START, "a", 1.0), (1, 1, START, "a", 1.0), (2, None, START, "a", 1.0), (3, 2, START, "a", 1.0)]
    df = spark.createDataFrame(rows, "txn_id long, cc_num long, timestamp timestamp_ntz, merchant string, amount double")
    assert {r.txn_id for r in sequence.sequence_features(df).collect()} == {0, 1, 3}
    assert sequence.unusable_card_report(df).first().dropped == 1


def test_without_any_card_all_rows_are_one_sequence(spark):
    rows = [(i, START + dt.timedelta(minutes=i), "a", 10.0) for i in range(7)]
    raw = spark.createDataFrame(rows, "txn_id long, trans_date_trans_time timestamp_ntz, merchant string, amt double")
    found = risk.risk_features(risk.risk_base(raw)).orderBy("txn_id").collect()
    assert [r.roll_cnt_N for r in found] == list(range(1, 8))
    assert [r.roll_std_N for r in found] == [None] * 4 + [0.0] * 3
    assert {r.amount_z for r in found} == {0.0}
    assert {(r.geo_missing, r.geo_dist_km) for r in found} == {(1, 0.0)}


@pytest.mark.parametrize("rows", [48, 49, 50, 51])
def test_baseline_starts_at_fifty_rows(spark, rows):
    data = spark.createDataFrame(transactions(n=rows)).withColumn("cc_num", F.lit(1))
    found = sequence.sequence_features(data, baseline=True).toPandas()
    assert (found.long_baseline > 0).sum() == max(0, rows - 49)


def test_empty_table(spark):
    empty = spark.createDataFrame(transactions(n=3)).limit(0)
    assert sequence.sequence_features(empty, baseline=True).count() == 0


def test_cards_as_text(spark):
    data = transactions(n=600)
    numbers = risk.risk_base(spark.createDataFrame(data))
    names = [c for c in NAMES.values()]
    found = []
    for card in (F.col("cc_num"), F.concat(F.lit(" 00"), F.col("cc_num").cast("string")), F.concat(F.lit("x-"), F.col("cc_num").cast("string"))):
        cards = risk.risk_base(spark.createDataFrame(data).withColumn("cc_num", card))
        rows = sequence.sequence_features(cards, baseline=True, min_block=250)
        found.append(rows.orderBy("txn_id").toPandas()[names])
    assert dict(numbers.dtypes)["cc_num"] == "bigint"
    pd.testing.assert_frame_equal(found[0], found[1])
    # Masked numbers are cards of their own; only the order of cards, so the baseline, may differ.
    pd.testing.assert_frame_equal(found[0][names[:-1]], found[2][names[:-1]])
