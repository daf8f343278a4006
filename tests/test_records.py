"""CSV folders with quoted line breaks and several headers, against the csv module over whole files."""

import csv
import io
import random

import pytest

from ledgerline.session import settings
from ledgerline.sources import records
from ledgerline.sources.headers import SchemaError

CELLS = ["a", "", "x y", 'say "hi"', "two\nlines", "\n", "a,b", '"', 'x"y', "é\r\nz", "\n\n,\n", "1.5", "long " * 40]


def as_line(cells):
    """A record as a writer would give it; a quote inside a plain cell stays unquoted at times."""
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    return out.getvalue()


def read(spark, path, split_bytes, names=records.raw_names):
    with settings(spark, {"spark.sql.files.maxPartitionBytes": str(split_bytes), "spark.sql.files.openCostInBytes": "1"}):
        return records.read_records(spark, str(path), names)


def as_rows(df):
    return sorted(tuple("~" if c is None else c for c in row) for row in df.collect())


@pytest.mark.parametrize("split_bytes", [60, 10**7])
def test_any_split_gives_the_records_of_the_whole_file(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    want, refused = [], []
    for f in range(2):
        lines = ["id,b,c"]
        for k in range(40):
            cells = [f"{f}-{k}", *(rng.choice(CELLS) for _ in range(rng.choice([1, 2, 2, 2, 3])))]
            line = as_line(cells)
            if rng.random() < 0.1:
                cells, line = [f"{f}-{k}", '5" nail', "z"], f'{f}-{k},5" nail,z'  # a quote within a plain cell is a quote
            lines += ["", line] if rng.random() < 0.1 else [line]
            if len(cells) > 3:
                refused.append((line, len(cells)))
            else:
                want.append(tuple(c or "~" for c in [*cells, "", ""][:3]))
        end = rng.choice(["\n", "\r\n"])
        (tmp_path / f"{f}.csv").write_text(end.join(lines) + end, newline="")
    found = read(spark, tmp_path, split_bytes)
    assert found.rows.columns == ["id", "b", "c"]
    assert as_rows(found.rows) == sorted(want)
    assert sorted((r.record.rstrip("\r"), r.fields, r.reason) for r in found.refused.collect()) == sorted((*r, "long") for r in refused)


def test_states_of_lines_agree_with_the_csv_module():
    rng = random.Random(9)
    for _ in range(3000):
        line = "".join(rng.choice('",ab"') for _ in range(rng.randrange(9)))
        for inside in (False, True):
            rows = list(csv.reader(io.StringIO(('"' if inside else "") + line + "\nzz")))
            assert records.state_after(line, inside) == (len(rows) == 1 and "\n" in rows[0][-1]), (line, inside)


@pytest.mark.parametrize("split_bytes", [30, 10**7])
def test_a_quote_that_never_closes_is_refused(spark, tmp_path, split_bytes):
    (tmp_path / "a.csv").write_text('id,b\n1,x\n2,"open\n3,y\n4,z\n')
    (tmp_path / "b.csv").write_text('id,b\n5,"fine\nhere"\n')
    found = read(spark, tmp_path, split_bytes)
    assert as_rows(found.rows) == [("1", "x"), ("5", "fine\nhere")]
    refused = found.refused.collect()
    assert {r.reason for r in refused} == {"torn"}
    assert sorted(line for r in refused for line in r.record.split("\n") if line) == ['2,"open', "3,y", "4,z"]


def test_a_long_record_over_many_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FRAGMENT_CHARS", 50)
    text = "\n".join(f"line {k} of a very long cell" for k in range(100))
    (tmp_path / "a.csv").write_text(f'id,b\n1,x\n2,"{text}"\n3,y\n')
    assert as_rows(read(spark, tmp_path, 300).rows) == [("1", "x"), ("2", text), ("3", "y")]


@pytest.mark.parametrize("split_bytes", [25, 10**7])
def test_each_file_has_its_own_header(spark, tmp_path, split_bytes):
    wide = ",".join(f"m{k}" for k in range(8))
    (tmp_path / "a.csv").write_text("Date,Payee,Amt\n2024-01-01,shop,1\n2024-01-02,bar,2\n")
    (tmp_path / "b.csv").write_text("\n\namount,timestamp,merchant,category\n3,2024-01-03,inn,food\n4,2024-01-04\n")
    (tmp_path / "c.csv").write_text(",".join(map(str, range(12))) + f"\n,trans_date_trans_time,merchant,amt,{wide}\n7,2024-01-05,den,5,{','.join('x' * 8)}\n")
    (tmp_path / "d.csv").write_text("\n \n")
    found = read(spark, tmp_path, split_bytes, records.canonical_names).rows
    rows = sorted((r.timestamp, r.merchant, r.amount, r.category) for r in found.collect())
    assert rows == [
        ("2024-01-01", "shop", "1", None), ("2024-01-02", "bar", "2", None), ("2024-01-03", "inn", "3", "food"),
        ("2024-01-04", None, "4", None), ("2024-01-05", "den", "5", None),
    ]
    raw = read(spark, tmp_path, split_bytes).rows
    assert raw.count() == 5 and {"Date", "amount", "trans_date_trans_time"} <= set(raw.columns)
    (tmp_path / "e.csv").write_text("x,y\n1,2\n")
    with pytest.raises(SchemaError):
        read(spark, tmp_path, split_bytes, records.canonical_names)


def test_splits_joined_in_order_without_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "BROADCAST_SPLITS", 0)
    lines = "".join(f'{k},"cell\n{k}"\n' for k in range(40))
    (tmp_path / "a.csv").write_text("id,b\n" + lines)
    assert as_rows(read(spark, tmp_path, 64).rows) == sorted((str(k), f"cell\n{k}") for k in range(40))


def test_no_lines_at_all(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n\n")
    with pytest.raises(ValueError):
        records.read_records(spark, str(tmp_path))
