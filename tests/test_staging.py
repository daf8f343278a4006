"""Staged tables and their owner."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import forest, order
from ledgerline.session import shared_folder, stage, staged_tables


def entries(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file://")))


def test_nothing_is_left_behind(spark):
    before = entries(spark)
    with staged_tables(spark) as owned:
        rows = spark.range(500).select(F.col("id").alias("txn_id"), (F.col("id") % 17).cast("double").alias("amount"))
        _, scored = forest.fit_isolation_forest(rows, ["amount"], trees=4, sample_size=16)
        assert scored.count() == 500 and order.order_rows(rows, ["txn_id"]).rows.count() == 500
        assert owned and entries(spark) > before
    assert entries(spark) == before


def test_an_error_leaves_nothing_either(spark):
    before = entries(spark)
    with pytest.raises(ZeroDivisionError), staged_tables(spark):
        stage(spark.range(3), "some")
        raise ZeroDivisionError
    assert entries(spark) == before


def test_inner_blocks_own_their_own(spark):
    before = entries(spark)
    with staged_tables(spark) as outer:
        kept = stage(spark.range(3), "kept")
        with staged_tables(spark) as inner:
            stage(spark.range(4), "gone")
        assert len(outer) == len(inner) == 1 and kept.count() == 3
        assert len(entries(spark) - before) == 1
    assert entries(spark) == before
    stage(spark.range(2), "ownerless")
    assert len(entries(spark) - before) == 1
