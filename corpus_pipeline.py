"""A corpus pipeline: toxic documents out, recurring lines out, one of each near-duplicate group, no benchmark, packed.

Each stage takes (spark, docs, sf_dir) and gives a table; all but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.decontaminate import without_benchmark
from ledgerline.llm.line_templates import drop_recurring_lines
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.partenum import near_duplicates
from ledgerline.llm.registry import table
from ledgerline.llm.toxicity import without_toxic
from ledgerline.session import stage

BROADCAST_IDS = 2_000_000  # of 8 bytes; a longer list meets the documents in a shuffle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go; the model learns from the training labels of the documents given."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from the texts; every document stays."""
    return drop_recurring_lines(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, repeated rows of it once; rows without a
    doc_id stay."""
    groups = stage(near_duplicates(docs), "components")
    dropped = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins of 2,048 words; duplicates have gone before, copies left conflict by their text."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # no stage is plain SQL; tests/llm checks each against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{number}")
    return docs
