"""Reading transaction CSV files in one pass, all columns as text."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
# A file with more columns than this whose first cell is a number has its header
# on the second line, unless this column is present.
DATA_LIKE_COLUMNS = 10
KNOWN_HEADER = "trans_date_trans_time"


def cells_of(line: str) -> list[str]:
    return next(csv.reader([line]))


def header_names(cells: list[str]) -> list[str]:
    """Column names of a header; blanks get ``Unnamed: i`` and repeats a running number."""
    names: list[str] = []
    seen: dict[str, int] = {}
    for position, cell in enumerate(cells):
        name = cell if cell else f"Unnamed: {position}"
        repeats = seen.get(name, 0)
        seen[name] = repeats + 1
        names.append(f"{name}.{repeats}" if repeats else name)
    return names


def first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first non-blank lines of the first file. A peek at names only: n is 2 at most."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return [row.value for row in lines.where(F.trim("value") != "").take(n)]


def probe_header(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Cells of the header and the line (0 or 1) they stand on."""
    lines = [cells_of(line) for line in first_lines(spark, path, 2)]
    if not lines:
        raise ValueError(f"no lines in {path}")
    return header_of(lines)


def header_of(lines: list[list[str]]) -> tuple[list[str], int]:
    """Which of the cells of a file's first two lines are its header, and where they stand."""
    first = lines[0]
    if len(lines) < 2 or len(first) <= DATA_LIKE_COLUMNS or KNOWN_HEADER in first:
        return first, 0
    second = lines[1]
    shifted = KNOWN_HEADER in second or (second[0].isdigit() and not _looks_like_names(first))
    return (second, 1) if shifted else (first, 0)


def _looks_like_names(cells: list[str]) -> bool:
    """A header holds no bare numbers."""
    return not any(cell.replace(".", "", 1).lstrip("+-").isdigit() for cell in cells)


def _field_count(record: Column) -> Column:
    unquoted = F.regexp_replace(record, '"[^"]*"', "")
    return F.size(F.split(unquoted, ","))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All records as text columns plus ``_corrupt_record``, set where the field count is off.

    Blank lines are skipped. The names come from the first file, and another file with other names is an error; where
    a line stands above the header, headers are not compared. Files stay splittable; a record is a line.
    """
    cells, header_line = probe_header(spark, path)
    names = header_names(cells)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    schema = schema.add(T.StructField(CORRUPT, T.StringType()))
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        # A pruned read does not count the fields of a line, so over-long lines would slip in.
        .option("columnPruning", False)
        .option("escape", '"')
        .option("recursiveFileLookup", True)
        # A file whose header differs is an error; laying the first file's names over it would swap columns.
        .option("enforceSchema", header_line == 1)
        .csv(path)
    )
    if header_line == 1:
        # The reader dropped the line above the header; the header itself comes as a row.
        is_header = F.lit(True)
        for name, cell in zip(names, cells):
            is_header = is_header & F.col(f"`{name}`").eqNullSafe(F.lit(cell or None).cast("string"))
        rows = rows.where(~is_header)
    return rows


def _too_long(df: DataFrame) -> Column:
    record = F.col(CORRUPT)
    return record.isNotNull() & (_field_count(record) > len(df.columns) - 1)


def read_transactions(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Usable records as text columns. Short ones are padded with NULL, over-long ones left out.

    With ``multiline`` quoted fields may hold line breaks and each file has a header of its own
    (:func:`ledgerline.sources.records.read_records`); files stay splittable either way.
    """
    if multiline:
        return _records(spark, path).rows
    rows = read_lines(spark, path)
    return rows.where(~_too_long(rows)).drop(CORRUPT)


def read_quarantine(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """The over-long records that :func:`read_transactions` leaves out, as text; with ``multiline`` torn ones as well."""
    if multiline:
        return _records(spark, path).refused.select("record", "fields")
    cells, _ = probe_header(spark, path)
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    counted = lines.select(F.col("value").alias("record"), _field_count(F.col("value")).alias("fields"))
    return counted.where(F.col("fields") > len(cells))


def _records(spark: SparkSession, path: str):
    from ledgerline.sources.records import read_records  # it builds on this module

    return read_records(spark, path)
