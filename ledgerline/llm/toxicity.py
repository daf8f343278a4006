"""Toxicity by multiple-instance learning.

A sentence's probability is logistic in its words and word beginnings, and 0 without a weighted one, so that length alone
is no evidence; a document is toxic unless all its sentences are clean (noisy-or). The sentence weights are trained from document labels alone; afterwards they tell which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.labelled import held_out, labelled_sample
from ledgerline.llm.words import Words, column, mix, stripped, unit_starts, word_slices
from ledgerline.session import stage

SAMPLE = 4000  # documents of either label that the model may be fitted on
BITS = 20
BEGINNING = 5  # bytes of a word's beginning
STEPS = 150
SLICE = 300_000  # bytes of text in work at a time
MIN_DOCS = 4  # sample documents that a feature must occur in to have a weight


def sentence_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by word: the word and its beginning), the sentence of each word, and the text of each sentence."""
    plain = stripped(words)
    full = plain.hashes()
    head = Words(plain.first, plain.data, plain.starts, np.minimum(plain.ends, plain.starts + BEGINNING), plain.bounds, plain.text_starts)
    begin = mix(head.hashes() + np.uint64(0x5851F42D4C957F2D))
    features = (np.stack([full, begin], axis=1) >> np.uint64(64 - BITS)).astype(np.int64)
    starts = unit_starts(words)
    sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(full))))
    return features, sentence, words.text_of_word()[starts] if len(starts) else starts


@dataclass
class ToxicityModel:
    weights: np.ndarray  # 2**BITS of them, nearly all 0
    bias: float

    def sentences(self, features: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Probability of each sentence; 0 without a weighted feature."""
        own = self.weights[features]
        z = np.bincount(sentence, weights=own.sum(axis=1), minlength=n)
        weighted = np.bincount(sentence, weights=(own != 0).any(axis=1), minlength=n) > 0
        return np.where(weighted, 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30))), 0.0)


def noisy_or(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(text, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def fit_toxicity(column_of: np.ndarray, row_of: np.ndarray, text: np.ndarray, labels: np.ndarray, size: int, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Gradient descent on the log loss of the documents' noisy-or: weights of ``size`` features and the bias.

    Feature ``column_of[k]`` stands in sentence ``row_of[k]``; sentence s, of those with a feature, belongs to document
    ``text[s]``, and ``labels`` has all documents.
    """
    n_sentences = len(text)
    n_clean, n_toxic = np.bincount(labels, minlength=2).tolist()
    w, bias = np.zeros(size), -5.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    weight = np.where(labels == 1, 0.5 / n_toxic, 0.5 / n_clean)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(row_of, weights=w[column_of], minlength=n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        whole = np.clip(noisy_or(p, text, len(labels)), 1e-9, 1 - 1e-9)
        slope = weight[text] * np.where(labels[text] == 1, -p * (1 - whole[text]) / whole[text], p)
        g = np.append(np.bincount(column_of, weights=slope[row_of], minlength=size) + 1e-6 * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def _documents_by_feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, feature, n): how many documents of a batch have a feature."""
    for batch in batches:
        labels, counts = column(batch, "label").to_numpy(), np.zeros((2, 1 << BITS), dtype=np.int32)
        for words in word_slices(column(batch, "text"), SLICE):
            found = sentence_features(words)[0]
            for k, (at, to) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
                counts[labels[words.first + k]][np.unique(found[at:to])] += 1
        label, feature = np.nonzero(counts)
        arrays = [pa.array(label.astype(np.int32)), pa.array(feature), pa.array(counts[label, feature].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=["label", "feature", "n"])


def _occurrences(features: np.ndarray):
    """(doc, sentence, place): where the chosen ``features``, by their place, stand in a document's sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[features] = np.arange(len(features), dtype=np.int32)
        for batch in batches:
            docs = column(batch, "doc").to_numpy()
            for words in word_slices(column(batch, "text"), SLICE):
                found, sentence, text = sentence_features(words)
                at, which = np.nonzero(place[found] >= 0)
                sentence = sentence[at]
                arrays = [docs[words.first + text[sentence]], sentence - np.searchsorted(text, text[sentence]), place[found[at, which]]]
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(pa.int64()) for x in arrays], names=["doc", "sentence", "place"])

    return run


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """A model from at most ``sample`` training documents of either label; a document with both labels is left out.

    Whole texts of the sample stay in the tasks. The driver gets the features that stand out among toxic documents, and
    where these stand.
    """
    agreed = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    rows = labelled_sample(docs, agreed, "toxic", 5, 0, sample).withColumn("doc", F.monotonically_increasing_id())
    rows = stage(rows.select("doc", "doc_id", "label", "text"), "toxicity-sample")
    of = rows.select("doc", "label", "doc_id").orderBy("doc_id", "doc").toPandas()
    truth = of["label"].to_numpy().astype(np.int64)
    nothing = ToxicityModel(np.zeros(1 << BITS, dtype=np.float32), -6.0)
    if not len(truth) or truth.min() == truth.max():
        return nothing
    n_clean, n_toxic = np.bincount(truth, minlength=2).tolist()
    counts = rows.select("label", "text").mapInArrow(_documents_by_feature, "label int, feature long, n long")
    clean, toxic = (F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)) for k in (0, 1))
    counts = counts.groupBy("feature").agg(clean.alias("clean"), toxic.alias("toxic"))
    # Only features that stand out among toxic documents may carry weight.
    counts = counts.where((F.col("clean") + F.col("toxic") >= MIN_DOCS) & ((F.col("toxic") + 0.5) / (n_toxic + 1) > 3 * (F.col("clean") + 0.5) / (n_clean + 1)))
    features = np.sort(counts.select("feature").toPandas()["feature"].to_numpy().astype(np.int64))
    if not len(features):
        return nothing
    found = rows.select("doc", "text").mapInArrow(_occurrences(features), "doc long, sentence long, place long").toPandas()
    keys = of["doc"].to_numpy()
    by_key = np.argsort(keys)  # documents are numbered in the order of doc_id, which layout does not change
    doc = by_key[np.searchsorted(keys[by_key], found["doc"].to_numpy())]
    order = np.lexsort((found["place"], found["sentence"], doc))
    doc, sentence, place = doc[order], found["sentence"].to_numpy()[order], found["place"].to_numpy()[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])
    weights, bias = fit_toxicity(place, np.cumsum(new) - 1, doc[new], truth, len(features))
    nothing.weights[features] = weights
    return ToxicityModel(nothing.weights, bias)


SCORED = "doc_id long, score double, offending array<int>"


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (1 from ``threshold`` on), and offending, the
    numbers, from 0, of the sentences whose own probability reaches ``threshold``.

    Labels are read only outside the held-out fold. Whole texts are scored in one pass. Defined cases: null and empty texts
    have no sentence and score 0; a null doc_id is not held out; repeated rows stay; labels other than 0 and 1 are
    ignored, and so are documents with both; without labels of both kinds no word has weight and every score is 0; other columns are ignored.
    """
    weights = train_toxicity(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(weights, threshold), SCORED)
    return rows.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending"
    )


def _scores(model: ToxicityModel, texts: pa.Array) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    for words in word_slices(texts, SLICE):
        features, sentence, text = sentence_features(words)
        p = model.sentences(features, sentence, len(text))
        yield words, noisy_or(p, text, words.n_texts), p, text


def _sparse(model: ToxicityModel) -> tuple[np.ndarray, np.ndarray, float]:
    """The weights that are not 0, which is what tasks are sent."""
    at = np.flatnonzero(model.weights)
    return at, model.weights[at], model.bias


def _dense(at: np.ndarray, values: np.ndarray, bias: float) -> ToxicityModel:
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[at] = values
    return ToxicityModel(weights, bias)


def _scorer(model: ToxicityModel, threshold: float):
    sent = _sparse(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _dense(*sent)
        for batch in batches:
            scores, offending = [], []
            for words, whole, p, text in _scores(own, column(batch, "text")):
                scores.append(whole)
                first = np.searchsorted(text, np.arange(words.n_texts + 1))
                bad = p >= threshold
                offending += [np.flatnonzero(bad[a:b]).tolist() for a, b in zip(first[:-1], first[1:])]
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), score, pa.array(offending, pa.list_(pa.int32()))], names=["doc_id", "score", "offending"]
            )

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``; rows with a null or empty text, a null doc_id,
    and repeated rows are judged by their text like others."""
    sent = _sparse(train_toxicity(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _dense(*sent)
        for batch in batches:
            clean = [whole < threshold for _, whole, _, _ in _scores(own, column(batch, "text"))]
            yield batch.filter(pa.array(np.concatenate(clean) if clean else np.zeros(0, dtype=bool)))

    return docs.mapInArrow(run, docs.schema)
