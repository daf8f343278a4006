"""A bounded, repeatable sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str, folds: int, fold: int):
    """Whether a document's label may not be learned from: crc32 of its id as text falls in the fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` documents of each label outside the fold, those with the least hash.

    The chosen ids are at most 2 * ``most`` rows, so they are broadcast and the texts are not shuffled.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold)
    )
    chosen = chosen.dropDuplicates(["doc_id"])
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = chosen.where("label = 0").orderBy(*order).limit(most).unionByName(chosen.where("label = 1").orderBy(*order).limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id")
