"""Features of a card's transaction sequence.

All of them come from one pass over blocks of rows in (card, time) order, see ``order.py``. A block
holds copies of the rows just before it, which rolling frames need, and carry rows with the visit
counts that a card cut by the block start already has. So a card of any size is spread over many
tasks and every figure is still exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.times import MICROS_PER_MINUTE, epoch_micros
from ledgerline.operators.order import MIN_BLOCK_ROWS, Ordered, first_key_of_blocks, order_rows, with_halo

# Figures of the sequence features.
ROLL_ROWS = 20
MIN_STAT_ROWS = 5
CONCENTRATION_DECAY = 0.3
FIRST_GAP_MINUTES = 1e6
SMALL_CHARGE = 5
SMALL_CHARGE_MINUTES = 10
RAPID_MINUTES = 2
BASELINE_ROWS = 200
BASELINE_MIN_ROWS = 50


def with_usable_card(df: DataFrame) -> DataFrame:
    """Rows without a card are left out, unless no row has one: then all rows are one sequence."""
    has_card = F.col("cc_num").isNotNull()
    return df.where(has_card) if df.where(has_card).select("cc_num").take(1) else df


def unusable_card_report(df: DataFrame) -> DataFrame:
    """How many rows :func:`with_usable_card` leaves out."""
    counts = df.agg(F.count("*").alias("rows"), F.count_if(F.col("cc_num").isNull()).alias("no_card"))
    dropped = F.when(F.col("no_card") < F.col("rows"), F.col("no_card")).otherwise(F.lit(0))
    return counts.select("rows", dropped.alias("dropped"))


def _carried_visits(ordered: Ordered) -> DataFrame:
    """What cards cut by a block start bring into the block: visits by merchant, and over all.

    Only the card that opens a block can be cut, so ``cut`` has at most one row per block. Visits
    are counted by block before anything is ordered, so a window sees one row per block.
    """
    cut = F.broadcast(first_key_of_blocks(ordered, F.col("cc_num")))
    by_block = (
        ordered.rows.join(cut, F.col("cc_num").eqNullSafe(F.col("_key")), "left_semi")
        .groupBy("cc_num", "merchant", "blk")
        .agg(F.count("*").alias("visits"))
    )
    by_merchant = W.partitionBy("cc_num", "merchant").orderBy("blk")
    upto = by_block.withColumn("upto", F.sum("visits").over(by_merchant.rowsBetween(W.unboundedPreceding, 0)))
    before_block = W.partitionBy("cc_num").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        upto.groupBy("cc_num", "blk")
        .agg(F.sum("visits").alias("visits"), F.max("upto").alias("most"))
        .select(
            "cc_num",
            "blk",
            F.sum("visits").over(before_block).alias("_card_weight"),
            F.max("most").over(before_block).alias("_most"),
        )
        .where(F.col("_card_weight").isNotNull())
    )
    merchants = upto.where(F.col("upto") > F.col("visits")).select(
        "cc_num", "blk", "merchant", (F.col("upto") - F.col("visits")).alias("_merchant_weight")
    )
    carried = merchants.unionByName(totals, allowMissingColumns=True)
    return carried.withColumns({"pos": F.lit(-1).cast("long"), "own": F.lit(False), "_carry": F.lit(True)})


def sequence_features(
    df: DataFrame,
    n: int = ROLL_ROWS,
    min_stat: int = MIN_STAT_ROWS,
    alpha: float = CONCENTRATION_DECAY,
    baseline: bool = False,
    min_block: int = MIN_BLOCK_ROWS,
) -> DataFrame:
    """Rolling, gap, concentration and swipe features for rows with ``txn_id`` and ``cc_num``.

    ``baseline`` adds ``long_baseline``: the rolling median of ``roll_sum_N`` over the whole table in
    (card, time) order.
    """
    usable = with_usable_card(df)
    text_cards = isinstance(usable.schema["cc_num"].dataType, T.StringType)
    if text_cards:  # numbers held as text keep the order of numbers
        usable = usable.withColumn("_card_number", F.col("cc_num").try_cast("bigint"))
    cards = ["_card_number", "cc_num"] if text_cards else ["cc_num"]
    ordered = order_rows(usable, [*cards, "timestamp", "txn_id"], min_block)
    halo = n - 1 + (BASELINE_ROWS - 1 if baseline else 0)
    rows = with_halo(ordered, halo)
    weight = F.col("own").cast("long")
    rows = rows.withColumns(
        {"_merchant_weight": weight, "_card_weight": weight, "_most": F.lit(None).cast("long"), "_carry": F.lit(False)}
    )
    if ordered.blocks > 1:
        rows = rows.unionByName(_carried_visits(ordered), allowMissingColumns=True)
    blocks = rows.repartition("blk")

    # One shuffle by block serves all windows; the card windows share one sort.
    merchant_rows = W.partitionBy("blk", "cc_num", "merchant").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    card = W.partitionBy("blk", "cc_num").orderBy("pos")
    so_far = card.rowsBetween(W.unboundedPreceding, 0)
    recent = card.rowsBetween(1 - n, 0)
    amount, count = F.col("amount"), F.col("roll_cnt_N")
    gap = (F.col("_micros") - F.lag("_micros").over(card)) / F.lit(MICROS_PER_MINUTE)
    enough = count >= min_stat
    z = (amount - F.col("roll_mean_N")) / F.nullif(F.col("roll_std_N"), F.lit(0.0))
    # A merchant's weight after k visits is (1 - q^k) / (1 - q), the card's after n is the same with
    # n; the largest share therefore belongs to the merchant with the most visits.
    decay = F.lit(1.0 - alpha)
    # Copied rows have no weight of their own and may have none before them.
    card_weight = F.nullif(1 - F.pow(decay, F.col("_card_visits")), F.lit(0.0))
    share = (1 - F.pow(decay, F.col("_most_visits"))) / card_weight
    short_gap = F.col("prev_txn_delta_min")
    features = (
        blocks.withColumn("_micros", epoch_micros(F.col("timestamp")))
        .withColumn("_visits", F.sum("_merchant_weight").over(merchant_rows))
        .withColumns(
            {
                "prev_txn_delta_min": F.coalesce(gap, F.lit(FIRST_GAP_MINUTES)),
                "roll_cnt_N": F.count("amount").over(recent),
                "roll_sum_N": F.sum("amount").over(recent),
                "roll_max_N": F.max("amount").over(recent),
                "_mean": F.avg("amount").over(recent),
                "_std": F.stddev_samp("amount").over(recent),
                "_card_visits": F.sum("_card_weight").over(so_far),
                "_most_visits": F.max(F.coalesce(F.col("_most"), F.col("_visits"))).over(so_far),
            }
        )
        .where(~F.col("_carry"))
        .withColumns({"roll_mean_N": F.when(enough, F.col("_mean")), "roll_std_N": F.when(enough, F.col("_std"))})
        .withColumns({"amount_z": F.coalesce(z, F.lit(0.0)), "merchant_conc_ewm": share})
        .withColumns(
            {
                "repeat_small_charge": ((amount < SMALL_CHARGE) & (short_gap < SMALL_CHARGE_MINUTES)).cast("int"),
                "rapid_swipes": (short_gap < RAPID_MINUTES).cast("int"),
            }
        )
    )
    kept = [c for c in features.columns if not c.startswith("_")]
    if baseline:
        # Card order is table order too, and already sorted by, unless cards are text.
        features = with_long_baseline(features.select(*kept), ["pos"] if text_cards else ["cc_num", "pos"])
    return features.where(F.col("own")).drop("pos", "blk", "own", *[c for c in features.columns if c.startswith("_")])


def with_long_baseline(blocks: DataFrame, order: list[str]) -> DataFrame:
    """``long_baseline``: median of the last 200 ``roll_sum_N`` in table order, 0 under 50 rows.

    Runs over the sorted rows of a block, batch by batch, and keeps 199 values between batches. Only
    two columns go to Python. The built-in ``percentile`` over a moving frame rebuilds its state for
    each row.
    """
    keep = BASELINE_ROWS - 1

    @F.pandas_udf("double")
    def rolling_median(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tail, tail_block = np.empty(0), None
        for blocks_of_rows, sums_of_rows in batches:
            block, sums = blocks_of_rows.to_numpy(), sums_of_rows.to_numpy()
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
            medians = np.empty(len(block))
            for start, end in zip(starts, [*starts[1:], len(block)]):
                before = tail if block[start] == tail_block else np.empty(0)
                run = np.concatenate([before, sums[start:end]])
                rolled = pd.Series(run).rolling(BASELINE_ROWS, min_periods=BASELINE_MIN_ROWS).median()
                medians[start:end] = rolled.fillna(0.0).to_numpy()[len(before) :]
                tail, tail_block = run[-keep:], block[start]
            yield pd.Series(medians)

    # The result depends on the rows before, so neither the sort nor a later filter may move past it.
    median_of = rolling_median.asNondeterministic()
    ordered = blocks.sortWithinPartitions("blk", *order)
    return ordered.withColumn("long_baseline", median_of("blk", "roll_sum_N"))
