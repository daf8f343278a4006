"""Conflict-constrained best-fit packing of documents into sequences of a fixed length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import stage

CAPACITY = 2048
SHARD_PIECES = 4096  # pieces packed together; the number of shards grows with the table
FULL_BINS = 1 << 62  # bins of full pieces are numbered from here on
WORDS = "[^\\x20\\x09-\\x0D]+"


class Bins:
    """Open bins ordered by residual, each with the bitmaps of the sources and duplicate clusters it holds."""

    def __init__(self, capacity: int):
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.levels = 0  # bit r: some bin has residual r
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _file(self, number: int, residual: int) -> None:
        if residual:
            self.by_residual[residual].append(number)
            self.levels |= 1 << residual

    def add(self, need: int, source: int, cluster: int, capacity: int) -> int:
        """The bin with the least residual of at least ``need`` that holds neither ``source`` nor ``cluster``."""
        above = self.levels >> need
        while above:
            residual = need + (above & -above).bit_length() - 1
            level = self.by_residual[residual]
            for place, number in enumerate(level):
                if not (self.sources[number] & source or self.clusters[number] & cluster):
                    del level[place]
                    if not level:
                        self.levels &= ~(1 << residual)
                    self.sources[number] |= source
                    self.clusters[number] |= cluster
                    self._file(number, residual - need)
                    return number
            above &= above - 1
        self.sources.append(source)
        self.clusters.append(cluster)
        self._file(len(self.sources) - 1, capacity - need)
        return len(self.sources) - 1


def pack(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> list[int]:
    """A bin number for each piece, pieces taken in the order given (longest first for best-fit decreasing)."""
    bits: dict = {}
    repeated = {c for c, n in pd.Series(clusters).value_counts().items() if n > 1}
    bins = Bins(capacity)
    result = []
    for length, source, cluster in zip(lengths, sources, clusters):
        own = 1 << bits.setdefault(("s", source), len(bits)) if source is not None else 0
        copy = 1 << bits.setdefault(("c", cluster), len(bits)) if cluster in repeated else 0
        result.append(bins.add(length, own, copy, capacity))
    return result


PACKED = "bin_id long, doc_id long, piece long, first_word long, n_words long, source string, cluster long"


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None) -> DataFrame:
    """Where each piece of each row of ``docs`` (doc_id, text, source) goes: bin_id, doc_id, piece, first_word, n_words.

    A text longer than ``capacity`` words is cut into full pieces, which fill bins alone, and a rest. No bin holds more
    words than ``capacity``, two pieces of one source or two of one duplicate cluster: the column named by ``cluster``,
    else the hash of the text with case and spacing levelled. Rests are dealt by hash to shards of about 4,096, packed
    longest first, each into the tightest compatible bin of its shard; a hot source or cluster is spread evenly, and rows
    that are all alike by their number in the files. Words are counted once; texts are never shuffled.

    Defined cases: a text without words, empty or null has one row with a null bin_id and 0 words; a null source conflicts
    with no other; null doc_ids and repeated rows are packed like others, copies apart; other columns are ignored.
    """
    level = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.xxhash64(level) if cluster is None else F.xxhash64(cluster)).alias("cluster"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORDS)).cast("long").alias("all_words"),
    )
    rows = stage(rows.withColumn("slot", F.monotonically_increasing_id()), "word-counts")
    full = F.floor(F.col("all_words") / capacity)
    fields = ["bin_id", "doc_id", "piece", "first_word", "n_words", "source", "cluster"]

    # A full piece fills a bin alone, so only what is left of each row goes to the packer.
    whole = rows.where(full > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
    whole = stage(whole.withColumn("number", F.monotonically_increasing_id()), "full-pieces").select(
        (F.col("number") + F.lit(FULL_BINS)).alias("bin_id"), "doc_id", "piece", (F.col("piece") * capacity).alias("first_word"),
        F.lit(capacity).cast("long").alias("n_words"), "source", "cluster",
    )
    rests = rows.withColumn("n_words", F.col("all_words") - full * capacity).where("n_words > 0")
    same = rests.groupBy("doc_id", "cluster").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("s_id"), F.col("cluster").alias("s_cluster"))
    repeated = F.col("s_cluster").isNotNull()
    rests = rests.join(same, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("cluster") == F.col("s_cluster")), "left").select(
        F.xxhash64("doc_id", "cluster", F.when(repeated, F.col("slot")).otherwise(-1)).alias("spread"),
        "doc_id", "source", "cluster", full.alias("piece"), (full * capacity).alias("first_word"), "n_words",
    )
    shards = max(1, -(-rows.where(F.col("all_words") % capacity > 0).count() // SHARD_PIECES))

    def fill(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_words", "doc_id", "piece", "spread"], ascending=[False, True, True, True])
        sources = [None if pd.isna(s) else s for s in shard["source"]]
        numbers = pack(shard["n_words"].tolist(), sources, shard["cluster"].tolist(), capacity)
        shard["bin_id"] = [int(k) * (1 << 32) + n for k, n in zip(shard["shard"], numbers)]
        return shard[fields]

    empty = rows.where("all_words = 0").select(
        F.lit(None).cast("long").alias("bin_id"), "doc_id", *(F.lit(0).cast("long").alias(c) for c in fields[2:5]), "source", "cluster"
    )
    filled = rests.withColumn("shard", F.pmod("spread", F.lit(shards))).groupBy("shard").applyInPandas(fill, PACKED)
    return filled.unionByName(whole).unionByName(empty)
