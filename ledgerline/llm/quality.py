"""Text quality by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled ones are drawn by hash from all documents outside the held-out
fold, whatever their label. The class prior is estimated from both, and a logistic model over binned figures of the text minimises the
non-negative unbiased risk: prior * risk of positives as good + max(0, risk of unlabelled as bad - prior * risk of positives
as bad).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.labelled import held_out, labelled_sample
from ledgerline.llm.words import DIGITS, Words, column, has_byte, stripped, unit_starts, window_hashes, word_slices

SAMPLE = 5000  # trusted positives that the model may be fitted on, and twice as many unlabelled documents
BINS = 16
STEPS = 400


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(flags, dtype=np.float64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _class(chars: str) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[[ord(c) for c in chars]] = True
    return flags


_SYMBOLS, _ENDS, _PUNCTUATION = _class("#*$%&|<>!=+~^_{}[]@\\/"), _class(".!?"), _class(",;:'\"()-")
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def text_figures(words: Words) -> np.ndarray:
    """A row of figures for each text of the slice; all of them 0 for a text without words."""
    bounds = words.bounds
    n = np.diff(bounds).astype(np.float64)
    per = np.maximum(n, 1)
    size = np.maximum(np.diff(words.text_starts).astype(np.float64), 1)
    length = (words.ends - words.starts).astype(np.float64)
    hashes = words.hashes()
    text = words.text_of_word()
    byte_sums = {k: np.concatenate(([0], np.cumsum(c[words.data], dtype=np.int64))) for k, c in (("symbol", _SYMBOLS), ("upper", _UPPER))}
    in_text = {k: (s[words.text_starts[1:]] - s[words.text_starts[:-1]]) / size for k, s in byte_sums.items()}
    mean = _per_text(length, bounds) / per
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    keyed = np.stack([text.astype(np.uint64), hashes]) if len(hashes) else np.zeros((2, 0), dtype=np.uint64)
    order = np.lexsort((keyed[1], keyed[0]))
    a, b = keyed[0][order], keyed[1][order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    distinct = np.bincount(a[first].astype(np.int64), minlength=len(n))
    windows = window_hashes(hashes, 3)
    window_text = text[: len(windows)]
    whole = window_text == text[2:] if len(windows) else np.zeros(0, dtype=bool)
    order = np.lexsort((windows[whole], window_text[whole]))
    a, b = window_text[whole][order], windows[whole][order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    distinct3 = np.bincount(a[first], minlength=len(n))
    units = np.bincount(text[unit_starts(words)], minlength=len(n)) if len(text) else np.zeros(len(n))
    ends = words.data[words.ends - 1] if len(length) else np.zeros(0, dtype=np.uint8)
    lone = length == 1
    core = stripped(words)
    figures = [
        np.log1p(n),
        np.log1p(size),
        mean,
        np.sqrt(np.maximum(_per_text(length**2, bounds) / per - mean**2, 0)),
        in_text["symbol"],
        in_text["upper"],
        _per_text(has_byte(words, _SYMBOLS), bounds) / per,
        _per_text(has_byte(words, DIGITS), bounds) / per,
        _per_text(_ENDS[ends], bounds) / per,
        _per_text(_PUNCTUATION[ends], bounds) / per,
        _per_text(same, bounds) / per,
        distinct / per,
        distinct3 / np.maximum(n - 2, 1),
        units / per,
        _per_text(lone, bounds) / per,
        _per_text(length <= 4, bounds) / per,
        _per_text(length >= 20, bounds) / per,
        _per_text((core.ends - core.starts) < length, bounds) / per,
    ]
    return np.where(n[:, None] > 0, np.stack(figures, axis=1), 0.0)


@dataclass
class QualityModel:
    edges: np.ndarray  # of the bins of each figure
    weights: np.ndarray  # by figure and bin
    bias: float
    prior: float  # share of good documents among the unlabelled

    def bins(self, figures: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, figures[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def scores(self, figures: np.ndarray) -> np.ndarray:
        z = self.bias + self.weights[np.arange(len(self.edges)), self.bins(figures)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _one_hot(bins: np.ndarray) -> np.ndarray:
    x = np.zeros((len(bins), bins.shape[1], BINS), dtype=np.float32)
    np.put_along_axis(x, bins[:, :, None], 1, axis=2)
    return x.reshape(len(bins), -1)


def _descend(gradient, size: int, rate: float = 0.05) -> np.ndarray:
    """Adam with the usual constants from zero weights."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        g = gradient(w.astype(np.float32)) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of the two scores' upper tails, positives' tail half or more."""
    limits = np.quantile(positive, np.linspace(0.005, 0.5, 100))
    ratios = [(unlabelled >= t).mean() / (positive >= t).mean() for t in limits]
    return float(np.clip(min(ratios), 0.01, 0.99))


def fit_quality(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> QualityModel:
    """Figures of trusted positives and of unlabelled documents to a model; empty samples give score 0.5 everywhere."""
    n = (positive if len(positive) else unlabelled).shape[1]
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros((n, BINS - 1)), np.zeros((n, BINS)), 0.0, 0.5)
    edges = np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    model = QualityModel(edges, np.zeros((n, BINS)), 0.0, 0.5)
    p, u = (np.hstack([_one_hot(model.bins(x)), np.ones((len(x), 1), dtype=np.float32)]) for x in (positive, unlabelled))
    if prior is None:
        halves = [np.arange(len(x)) % 2 == 0 for x in (p, u)]
        ptrain, utrain = p[halves[0]], u[halves[1]]

        def apart(w: np.ndarray) -> np.ndarray:
            return ptrain.T @ (_sigmoid(ptrain @ w) - 1) / len(ptrain) + utrain.T @ _sigmoid(utrain @ w) / len(utrain)

        w = _descend(apart, p.shape[1])
        prior = estimate_prior(p[~halves[0]] @ w if (~halves[0]).any() else p @ w, u[~halves[1]] @ w if (~halves[1]).any() else u @ w)

    def risk_gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        as_bad = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        good = prior * (p.T @ (_sigmoid(zp) - 1)) / len(p)
        bad = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        return good + bad if as_bad >= 0 else -bad  # a negative risk is walked back

    w = _descend(risk_gradient, p.shape[1])
    return QualityModel(edges, w[:-1].reshape(n, BINS), float(w[-1]), prior)


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [row.tobytes() for words in word_slices(column(batch, "text")) for row in text_figures(words)]
        yield pa.RecordBatch.from_arrays(
            [column(batch, "label"), column(batch, "key"), pa.array(rows, pa.binary())], names=["label", "key", "figures"]
        )


def unlabelled_sample(docs: DataFrame, most: int) -> DataFrame:
    """(key, text) of the documents outside the held-out fold with the ``most`` least hashes of their id, or of their text
    without one. The cut is fetched as a number; texts are not shuffled."""
    doc_id = F.col("doc_id").cast("long")
    key = F.xxhash64(doc_id, F.when(doc_id.isNull(), F.col("text")), F.lit("unlabelled"))
    rows = docs.where(~held_out("doc_id", 4, 2)).select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    cut = rows.select("key").distinct().orderBy("key").limit(most).agg(F.max("key")).first()[0]
    return rows.where(F.col("key") <= F.lit(cut).cast("long"))


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """A model from at most ``sample`` training documents labelled good, the trusted positives, and twice as many unlabelled
    ones of all training documents. Repeated rows of a document count once."""
    positive = labelled_sample(docs, labels.where(F.col("quality").cast("int") == 1), "quality", 4, 2, sample)
    rows = positive.select("label", F.xxhash64("doc_id").alias("key"), "text").unionByName(
        unlabelled_sample(docs, 2 * sample).select(F.lit(0).alias("label"), "key", "text")
    )
    found = rows.mapInArrow(_figures, "label int, key long, figures binary").dropDuplicates().collect()
    width = text_figures(next(word_slices(pa.array([""])))).shape[1]
    parts = (
        np.array(sorted((np.frombuffer(r["figures"]) for r in found if r["label"] == y), key=bytes)).reshape(-1, width) for y in (1, 0)
    )
    turn = np.random.default_rng(7)
    return fit_quality(*(x[turn.permutation(len(x))] for x in parts))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score and predicted (1 from ``threshold`` on).

    Labels are read only outside the held-out fold, and only label 1, to choose the trusted positives. Whole texts are scored in one
    pass. Defined cases: null and empty texts get the score of a text without words; a null doc_id is not held out; repeated
    rows stay; labels other than 1 are ignored; without any label 1 every score is 0.5; other columns are ignored.
    """
    model = train_quality(docs, labels, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(text_figures(words)) for words in word_slices(column(batch, "text"))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
