"""CSV folders whose files differ in their headers and whose quoted fields hold line breaks, read from splittable files.

Whether a split of a file begins inside a quoted field is not known from the split. So each split is first read under both
assumptions, which gives a map from the state at its beginning to the state at its end; a prefix over the maps of a file's
splits then tells where each one begins. A second pass cuts the splits into records. A record that goes over the edge of a
split comes out in fragments, which are few, and these are put together by file.

The same first pass sees the first lines of every file, so each file is read by its own header.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.session import settings, stage
from ledgerline.sources.csv import cells_of, header_names, header_of
from ledgerline.sources.headers import OPTIONAL, REQUIRED, SchemaError, match_schema

BROADCAST_SPLITS = 200_000  # of about 100 bytes
MOST_HEADERS = 10_000  # different headers in one folder
NO_HEADER = -1  # of a file of blank lines
FRAGMENT_CHARS = 1_000_000  # of a record that goes over the edge of a split come in one row
SPLIT = ["file", "block", "length"]
SPLITS_AT_LEAST = "spark.sql.files.minPartitionNum"


def after_quotes(line: str, at: int) -> int:
    """Position behind the quote that closes a field, or -1; a doubled quote is part of the field."""
    while True:
        at = line.find('"', at)
        if at < 0:
            return -1
        if line[at + 1 : at + 2] != '"':
            return at + 1
        at += 2


def state_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind ``line``. A quote opens a field only at the field's beginning."""
    at = 0
    if inside:
        at = after_quotes(line, 0)
        if at < 0:
            return True
        at = line.find(",", at) + 1
        if not at:
            return False
    while True:
        if line[at : at + 1] == '"':
            at = after_quotes(line, at + 1)
            if at < 0:
                return True
            at = line.find(",", at) + 1
            if not at:
                return False
        else:
            at = line.find(',"', at) + 1
            if not at:
                return False


def cells_of_record(record: str) -> list[str | None] | None:
    """The cells of one whole record, an empty one as None; None for a record that is not well formed."""
    if '"' not in record:
        return [c or None for c in record.split(",")]
    csv.field_size_limit((1 << 31) - 1)
    try:
        rows = list(csv.reader([record]))
    except csv.Error:
        return None
    return [c or None for c in rows[0]] if len(rows) == 1 else None


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: the states behind it if it begins outside or inside a quoted field, and its first two lines that are not blank."""
    here, after, heads = None, [False, True], []

    def found() -> pa.RecordBatch:
        arrays = [*([x] for x in (*here, *after)), [heads]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(arrays, kinds)], names=[*SPLIT, "to_0", "to_1", "heads"])

    for batch in batches:
        for part in _by_split(batch):
            split = tuple(part.column(k)[0].as_py() for k in (1, 2, 3))
            if split != here:
                if here:
                    yield found()
                here, after, heads = split, [False, True], []
            values = part.column(0)
            for line in values.filter(pc.match_substring(values, '"')).to_pylist():
                after = [state_after(line, state) for state in after]
            if len(heads) < 2:
                heads += [x.rstrip("\r") for x in values.to_pylist() if x.strip()][: 2 - len(heads)]
    if here:
        yield found()


def _by_split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of one split each; rows of a split stand together."""
    n = batch.num_rows
    if not n:
        return
    same = pc.and_(pc.equal(batch.column(1)[1:], batch.column(1)[:-1]), pc.equal(batch.column(2)[1:], batch.column(2)[:-1]))
    cuts = [0, *(k + 1 for k, s in enumerate(same.to_pylist()) if not s), n]
    for at, to in zip(cuts, cuts[1:]):
        yield batch.slice(at, to - at)


RECORDS = "file long, block long, header_id int, cells array<string>, record string, fields int, part long, opens boolean, closes boolean"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split: their cells, or the record itself where these are too many. Fragments have ``part`` set, a
    running number in the split, and say whether they open and close the record."""
    here, inside, skip, held, size, begun, part_no = None, False, 0, [], 0, False, 0
    rows: list[tuple] = []

    def fragment(closes: bool) -> None:
        nonlocal held, size, begun, part_no
        rows.append((here[0], here[1], here[2], None, "\n".join(held), None, part_no, not begun, closes))
        held, size, begun, part_no = [], 0, not closes, part_no + 1

    def whole(record: str) -> None:
        cells = cells_of_record(record.removesuffix("\r"))
        good = cells is not None and len(cells) <= here[3]
        rows.append((here[0], here[1], here[2], cells if good else None, None if good else record, len(cells) if cells else None, None, None, None))

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_())
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[f.split()[0] for f in RECORDS.split(", ")])
        rows.clear()
        return batch

    for batch in batches:
        for part in _by_split(batch):
            split = tuple(part.column(k)[0].as_py() for k in (1, 2, 4, 5))
            if split != here:
                if held:
                    fragment(False)
                here, inside, skip = split, part.column(6)[0].as_py(), part.column(7)[0].as_py()
                held, size, begun, part_no = [], 0, inside, 0
                if here[2] is None:
                    raise RuntimeError("the files were cut into other splits than before; read them again")
            for line in part.column(0).to_pylist():
                if not inside and not held:
                    if not line.strip():
                        continue
                    if skip:
                        skip -= 1
                        continue
                inside = state_after(line, inside) if inside or '"' in line else False
                held.append(line)
                size += len(line)
                if not inside and not begun:
                    whole("\n".join(held))
                    held, size = [], 0
                elif not inside:
                    fragment(True)
                elif size > FRAGMENT_CHARS:
                    fragment(False)
        if rows:
            yield flush()
    if held:
        fragment(False)
    if rows:
        yield flush()


@dataclass(frozen=True)
class Records:
    """Records of a folder by the header of their own file, and those that fit none."""

    rows: DataFrame  # the columns of all headers
    refused: DataFrame  # record, fields, reason: 'long', or 'torn' for a quoted field that never closes


def raw_names(cells: list[str]) -> dict[str, int]:
    """Every column under its own name."""
    return {name: k for k, name in enumerate(header_names(cells))}


def canonical_names(cells: list[str]) -> dict[str, int]:
    """The columns that match a canonical field, under its name."""
    names = header_names(cells)
    match = match_schema(names)
    if match.missing:
        raise SchemaError(f"no column found for {match.missing}; rename headers, have {names}")
    return {field: names.index(source) for field, source in match.found.items()}


def _scan(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    return lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("length"))


def _states(splits: DataFrame) -> DataFrame:
    """``splits`` with ``inside``, the state in which each begins, and ``ends_inside``: a prefix over the maps of its file."""
    by_file = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    constant = F.col("to_0") == F.col("to_1")
    swaps = F.sum((F.col("to_0") & ~F.col("to_1")).cast("int")).over(by_file)
    counted = splits.withColumn("swaps", swaps)
    known = F.last(F.when(constant, F.struct(F.col("to_0").alias("state"), F.col("swaps").alias("at"))), ignorenulls=True).over(by_file)
    counted = counted.withColumn("known", known)
    odd = (F.col("swaps") - F.coalesce("known.at", F.lit(0))) % 2 == 1
    ends = F.coalesce("known.state", F.lit(False)) != odd
    before = W.partitionBy("file").orderBy("block")
    return counted.withColumn("ends_inside", ends).withColumn("inside", F.coalesce(F.lag("ends_inside").over(before), F.lit(False)))


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The header line of each file and how many lines it and one above it take."""
    for batch in batches:
        rows = []
        for file, heads in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if heads:
                at = header_of([cells_of(line) for line in heads])[1]
                rows.append((file, heads[at], at + 1))
        kinds = (pa.int64(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["file", "header", "skipped"])


def _with_headers(splits: DataFrame, names: Callable[[list[str]], dict[str, int]]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Splits with header_id, width and the lines to skip; (header_id, width, places) of the different headers; all columns."""
    spark = splits.sparkSession
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("n_before", F.coalesce(F.sum(F.size("heads")).over(earlier), F.lit(0)))
    heads = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "heads"))), lambda s: s["heads"]))
    files = splits.where("n_before < 2").groupBy("file").agg(F.slice(heads, 1, 2).alias("heads"))
    files = stage(files.mapInArrow(_chosen, "file long, header string, skipped int"), "csv-headers")
    lines = [row.header for row in files.select("header").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(lines) > MOST_HEADERS:
        raise SchemaError(f"more than {MOST_HEADERS} different headers")
    found = [(line, len(cells_of(line)), names(cells_of(line))) for line in sorted(lines)]
    columns = list(dict.fromkeys(name for _, _, places in found for name in places))
    if names is canonical_names:
        columns = [name for name in REQUIRED + OPTIONAL if name in columns]
    rows = [(k, line, width, [places.get(name, -1) for name in columns]) for k, (line, width, places) in enumerate(found)]
    headers = spark.createDataFrame(rows, "header_id int, header string, width int, places array<int>")
    skip = F.greatest(F.lit(0), F.least(F.size("heads"), F.col("skipped") - F.col("n_before"))).cast("int")
    known = splits.join(files, "file", "left").join(F.broadcast(headers), "header", "left")
    header_id = F.coalesce("header_id", F.lit(NO_HEADER)).alias("header_id")
    return known.select(*SPLIT, header_id, "width", "inside", skip.alias("skip"), "ends_inside"), headers.drop("header"), columns


def _cut(spark: SparkSession, path: str, splits: DataFrame, few: bool) -> DataFrame:
    """The records of the lines in ``splits``. A broadcast leaves the lines in the order of the file; beyond ``few`` splits
    they are shuffled by split and sorted back."""
    fields = ["value", *SPLIT, "header_id", "width", "inside", "skip"]
    if few:
        rows = _scan(spark, path).join(F.broadcast(splits), SPLIT, "left")
    else:
        rows = _scan(spark, path).withColumn("slot", F.monotonically_increasing_id()).join(splits.hint("merge"), SPLIT, "left")
        rows = rows.repartition(*SPLIT).sortWithinPartitions(*SPLIT, "slot")
    return rows.select(*fields).mapInArrow(_records, RECORDS)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of records that have been put together."""
    for batch in batches:
        cells = [cells_of_record(record.removesuffix("\r")) for record in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.string()))], names=["header_id", "record", "cells"])


def _together(fragments: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header_id, cells, record, fields) of records over edges of splits, and the fragments of those that never close."""
    in_order = W.partitionBy("file").orderBy("block", "part").rowsBetween(W.unboundedPreceding, 0)
    numbered = fragments.withColumn("number", F.sum(F.col("opens").cast("int")).over(in_order))
    closed = numbered.groupBy("file", "number").agg(F.max("closes").alias("closed"))
    numbered = numbered.join(closed, ["file", "number"])
    record = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("block", "part", "record"))), lambda f: f["record"]))
    whole = numbered.where("closed").groupBy("file", "number").agg(F.first("header_id").alias("header_id"), record.alias("record"))
    whole = whole.select("header_id", "record").mapInArrow(_parsed, "header_id int, record string, cells array<string>")
    good = F.col("cells").isNotNull() & (F.size("cells") <= F.col("width"))
    whole = whole.join(F.broadcast(headers), "header_id").select(
        "header_id", F.when(good, F.col("cells")).alias("cells"), F.when(~good | F.col("cells").isNull(), F.col("record")).alias("record"),
        F.when(F.col("cells").isNotNull(), F.size("cells")).alias("fields"),
    )
    return whole, numbered.where(~F.col("closed"))


def read_records(spark: SparkSession, path: str, names: Callable[[list[str]], dict[str, int]] = raw_names) -> Records:
    """Usable records of all files under ``path`` as text columns, and the refused ones.

    ``names`` gives the columns of a header and their places: :func:`raw_names`, or :func:`canonical_names` for files that
    name the same fields differently. A column that a file lacks is NULL there; short records are padded with NULL; blank
    lines are no records; of a file whose last quoted field never closes, the lines from that record on are refused.

    Files are read twice, each split by itself whatever the length of its records, and the cells are staged; only splits'
    states and fragments are shuffled. Both passes must cut the files alike, so the number that Spark's cut depends on is
    held, and lines of a split that the first pass has not seen are an error.
    """
    at_least = spark.conf.get(SPLITS_AT_LEAST, None) or str(spark.sparkContext.defaultParallelism)
    with settings(spark, {SPLITS_AT_LEAST: at_least}):
        return _read_records(spark, path, names)


def _read_records(spark: SparkSession, path: str, names: Callable[[list[str]], dict[str, int]]) -> Records:
    lines = _scan(spark, path).mapInArrow(_splits, "file long, block long, length long, to_0 boolean, to_1 boolean, heads array<string>")
    states = stage(_states(stage(lines, "csv-splits")), "csv-states")
    splits, headers, columns = _with_headers(states, names)
    if not columns:
        raise ValueError(f"no lines in {path}")
    splits = stage(splits, "csv-splits")
    records = stage(_cut(spark, path, splits, splits.count() <= BROADCAST_SPLITS), "csv-records")
    rows = records.where("part IS NULL").select("header_id", "cells", "record", "fields")
    torn = None
    fragments = records.where("part IS NOT NULL")
    if not splits.where("inside OR ends_inside").isEmpty():
        together, torn = _together(fragments, headers)
        rows = rows.unionByName(stage(together, "csv-together"))
    placed = rows.where("record IS NULL").join(F.broadcast(headers), "header_id")
    usable = placed.select(*(F.get("cells", F.col("places")[k]).alias(name) for k, name in enumerate(columns)))
    reason = F.when(F.col("fields").isNull(), F.lit("torn")).otherwise(F.lit("long"))
    refused = rows.where("record IS NOT NULL").select("record", "fields", reason.alias("reason"))
    if torn is not None:
        refused = refused.unionByName(torn.select("record", F.lit(None).cast("int").alias("fields"), F.lit("torn").alias("reason")))
    return Records(usable, refused)
