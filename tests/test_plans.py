"""What the plans must not do: row-level work in one task, Python outside two operators, wide scans."""

import os

import pytest

import __spark_entry__ as entry
from catalog import views

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")

PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow", "PythonMapInArrow")
SPENDING = [
    "category_spend", "kpi_summary", "spend_weekly", "top_merchants", "high_spend_z", "weekend_ratio", "time_of_day",
    "merchant_entropy", "recurring_charges", "merchants_due", "budget_vs_actual", "profile_duplicates", "eval_f1", "amount_bin_q4",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SPENDING)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert not any(node in text for node in PYTHON_NODES)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(entry.queries()["category_spend"](spark, SF_DIR))
    schema = text.split("ReadSchema: ")[1].split(">")[0]
    assert "user_id" not in schema and "event_type" in schema


def test_sequence_features_shuffle_rows_once_after_the_sort(spark):
    from ledgerline.operators import risk

    features = risk.risk_features(risk.risk_base(views.raw_risk(spark, SF_DIR)))
    text = plan(features)
    assert text.count("REPARTITION_BY_COL") == 1
    assert not any(node in text for node in PYTHON_NODES)
    # The only single-partition step is the prefix sum over one row per sorted partition.
    assert text.count("Exchange SinglePartition") <= 1
