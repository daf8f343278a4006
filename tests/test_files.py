"""Reading and writing files."""

import datetime as dt
import json

import pytest

from ledgerline.session import shared_folder, stage
from ledgerline.sources import csv, sinks

HEADER = "id,date,merchant,amount"


def write(folder, **files):
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_short_blank_and_over_long_lines(spark, tmp_path):
    path = write(tmp_path, a=[HEADER, '1,2020,"a, ""b""",5', "2,2020", "", '3,2020,"x, y",7,extra', "4,2021,b,"], b=[HEADER, "5,2022,c,1"])
    rows = csv.read_transactions(spark, path)
    found = sorted((r.id, r.merchant, r.amount) for r in rows.collect())
    assert found == [("1", 'a, "b"', "5"), ("2", None, None), ("4", "b", None), ("5", "c", "1")]
    # A narrow read must leave the over-long line out too.
    assert sorted(r.id for r in rows.select("id").collect()) == ["1", "2", "4", "5"]
    refused = csv.read_quarantine(spark, path).collect()
    assert [(r.record, r.fields) for r in refused] == [('3,2020,"x, y",7,extra', 5)]


def test_header_on_the_second_line(spark, tmp_path):
    names = [",trans_date_trans_time", *[f"c{i}" for i in range(10)]]
    row = ",".join(["7", "2020-01-01", *["v"] * 10])
    path = write(tmp_path, a=[",".join(map(str, range(12))), ",".join(names), row], b=[",".join(map(str, range(12))), ",".join(names), row])
    rows = csv.read_transactions(spark, path)
    assert rows.columns[:2] == ["Unnamed: 0", "trans_date_trans_time"]
    assert [r[0] for r in rows.collect()] == ["7", "7"]


def test_header_names():
    assert csv.header_names(csv.cells_of('"a, b",,a,a')) == ["a, b", "Unnamed: 1", "a", "a.1"]


def test_empty_input_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n")
    with pytest.raises(ValueError):
        csv.read_transactions(spark, str(tmp_path))


def test_sinks(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 31), ["a", "b"]), (2, dt.datetime(2024, 2, 1), [])]
    df = spark.createDataFrame(rows, "id int, timestamp timestamp_ntz, reasons array<string>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert {(r.id, r.reasons) for r in csv.read_transactions(spark, str(tmp_path / "csv")).collect()} == {("1", "a,b"), ("2", None)}
    sinks.write_by_month(df, str(tmp_path / "months"))
    assert sorted(p.name for p in (tmp_path / "months").glob("month=*")) == ["month=2024-01", "month=2024-02"]
    sinks.write_json(df.select("id"), str(tmp_path / "json"))
    lines = [json.loads(x) for p in (tmp_path / "json").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(x["id"] for x in lines) == [1, 2]


def test_staged_tables_go_to_the_shared_folder(spark):
    staged = stage(spark.range(3).selectExpr("id", "timestamp_ntz'2024-01-01' as t"), "probe")
    assert staged.count() == 3 and dict(staged.dtypes)["t"] == "timestamp_ntz"
    assert all(f.startswith(f"file://{shared_folder(spark)}/probe-") for f in staged.inputFiles())


def test_files_with_other_column_order_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,merchant,amount\n2024-01-01,Shop A,1\n")
    (tmp_path / "b.csv").write_text("merchant,date,amount\nShop C,2024-01-03,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv.read_transactions(spark, str(tmp_path)).collect()


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,merchant,amount\n2024-01-01,"Shop\nA",1\n')
    rows = csv.read_transactions(spark, str(tmp_path), multiline=True).collect()
    assert [(r.merchant, r.amount) for r in rows] == [("Shop\nA", "1")]
