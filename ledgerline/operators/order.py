"""Rows in a total order, cut into even blocks.

A window over the whole table, or over one card that holds a third of it, would run in one task.
Here rows get their global position and are cut into blocks of equal size instead, with copies of
the last rows of the block before. Block size depends on the row count only, never on a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.session import stage

MIN_BLOCK_ROWS = 16_384
MAX_BLOCKS = 200_000
ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


@dataclass(frozen=True)
class Ordered:
    """Rows with ``pos`` (0-based, global) and ``blk`` (position over block size)."""

    rows: DataFrame
    block_rows: int
    blocks: int


def order_rows(df: DataFrame, by: list[str], min_block: int = MIN_BLOCK_ROWS) -> Ordered:
    """Sort by ``by``, which should be unique, and number the rows.

    One range shuffle; the sorted rows are staged so that the numbers hold for good. The prefix sum
    runs over one row per sorted partition, so it and its broadcast are bounded by their number.
    """
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    staged = stage(ranged.withColumn("_slot", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_slot", ROW_BITS)
    row_in_part = F.col("_slot").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        staged.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    total = staged.count()  # from the file footers
    block_rows = max(min_block, -(-total // MAX_BLOCKS))
    rows = (
        staged.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("pos", F.col("_start") + row_in_part)
        .withColumn("blk", F.floor(F.col("pos") / block_rows).cast("long"))
        .drop("_part", "_slot", "_start")
    )
    return Ordered(rows, block_rows, -(-total // block_rows))


def with_halo(ordered: Ordered, halo: int) -> DataFrame:
    """Each row in its own block (``own`` true); the last ``halo`` rows of a block also in the next."""
    if halo >= ordered.block_rows:
        raise ValueError(f"halo {halo} does not fit in blocks of {ordered.block_rows} rows")
    if ordered.blocks <= 1:
        return ordered.rows.withColumn("own", F.lit(True))
    blk, offset = F.col("blk"), F.col("pos") % ordered.block_rows
    copies = F.when(offset >= ordered.block_rows - halo, F.array(blk, blk + 1)).otherwise(F.array(blk))
    columns = [c for c in ordered.rows.columns if c != "blk"]
    return ordered.rows.select(*columns, blk.alias("_home"), F.explode(copies).alias("blk")).select(
        *columns, "blk", (F.col("_home") == F.col("blk")).alias("own")
    )


def first_key_of_blocks(ordered: Ordered, key: Column) -> DataFrame:
    """Keys that open a block other than the first: the only ones a block cut can split.

    At most one row per block, so never more than ``MAX_BLOCKS`` rows (or rows / MIN_BLOCK_ROWS).
    """
    opens = (F.col("pos") % ordered.block_rows == 0) & (F.col("pos") > 0)
    return ordered.rows.where(opens).select(key.alias("_key")).distinct()
