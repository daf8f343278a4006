"""From a raw transactions table to facts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ledgerline.operators.categorizer import categorize
from ledgerline.operators.cleaning import clean
from ledgerline.operators.facts import category_fallback, make_facts
from ledgerline.operators.features import model_features
from ledgerline.sources.headers import align_canonical


def facts_from_raw(
    df: DataFrame,
    model: PipelineModel | None = None,
    edges: list[float] | None = None,
    keep: tuple[str, ...] = ("txn_id",),
) -> DataFrame:
    """Align, clean, categorise (or fall back to the given category) and derive the facts.

    Columns named by ``keep`` are carried along when the table has them.
    ``edges`` are the amount-bin edges saved with the model; without them the bins are those of the
    batch itself. Persist or write the result before running several insights on it.
    """
    cleaned = clean(align_canonical(df, tuple(c for c in keep if c in df.columns)))
    if model is None:
        return make_facts(category_fallback(cleaned))
    return make_facts(categorize(model_features(cleaned, edges=edges), model))
