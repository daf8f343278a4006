"""Words of a whole Arrow string column at once, as numpy arrays over its UTF-8 bytes.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. All positions are byte positions in the slice's buffer; a word
never crosses from one text to the next. Texts are taken in slices of a few MB so that the 64-bit arrays stay small,
however long a text or a batch is (one longer text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    base[0] = inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``n`` of them."""
    return _powers(max(SLICE_BYTES + 1, 1 << int(n).bit_length() if n > SLICE_BYTES + 1 else 0))


@dataclass
class Words:
    """The words of the texts ``first`` to ``first + len(bounds) - 1`` of a column."""

    first: int
    data: np.ndarray  # the slice's bytes
    starts: np.ndarray  # of each word
    ends: np.ndarray
    bounds: np.ndarray  # for text i its words are bounds[i]:bounds[i + 1]
    text_starts: np.ndarray  # byte position where each text begins, and where the last one ends

    @property
    def n_texts(self) -> int:
        return len(self.bounds) - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each lower-cased word."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_byte_values()[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _words(data: np.ndarray, offsets: np.ndarray, first: int) -> Words:
    inside = ~spaces(data)
    starts, ends = inside.copy(), inside.copy()
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[edges] = False
    starts &= ~before
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends &= ~after
    begin = np.flatnonzero(starts)
    return Words(first, data, begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, offsets), offsets)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The column's texts in order, in slices of about ``limit`` bytes: the first text's number, the slice's bytes, and the
    positions where its texts begin and the last one ends; a null text is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The column's texts in order, in slices of about ``limit`` bytes; a null text has no words."""
    for first, data, offsets in text_slices(texts, limit):
        yield _words(data, offsets, first)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` items from each position on, in order; the last ``size - 1`` positions are left out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(_BASE) + hashes[k : k + n]
    return mix(total + np.uint64(size))


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of a whole sequence and its length."""
    total = 0
    for h in hashes.tolist():
        total = (total * _BASE + h) & _MASK
    return int(mix(np.array([(total + len(hashes) * 0x632BE59BD9B4E019) & _MASK], dtype=np.uint64))[0])


#: Fewer rows in an Arrow batch, as a row may hold a long text.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold while the block runs jobs."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def unit_starts(words: Words) -> np.ndarray:
    """Indices of the words that begin a sentence: after an end mark, a line break or a text's beginning."""
    n = len(words.starts)
    if not n:
        return np.zeros(0, dtype=np.int64)
    breaks = np.concatenate(([0], np.cumsum(words.data == 10)))
    begins = np.ones(n, dtype=bool)
    begins[1:] = _ENDS[words.data[words.ends[:-1] - 1]] | (breaks[words.starts[1:]] > breaks[words.ends[:-1]])
    begins[words.bounds[:-1][words.bounds[:-1] < n]] = True
    return np.flatnonzero(begins)


_LETTER = np.ones(256, dtype=bool)
_LETTER[[c for c in range(33, 128) if not chr(c).isalnum()]] = False


def stripped(words: Words, times: int = 3) -> Words:
    """The words without up to ``times`` ASCII punctuation marks at either end; a word of such marks keeps one."""
    starts, ends = words.starts.copy(), words.ends.copy()
    for _ in range(times):
        ends -= (~_LETTER[words.data[ends - 1]] & (ends - starts > 1)).astype(ends.dtype)
        starts += (~_LETTER[words.data[starts]] & (ends - starts > 1)).astype(starts.dtype)
    return Words(words.first, words.data, starts, ends, words.bounds, words.text_starts)


def has_byte(words: Words, wanted: np.ndarray) -> np.ndarray:
    """Whether each word holds one of the byte values that ``wanted`` (256 flags) marks."""
    sums = np.concatenate(([0], np.cumsum(wanted[words.data], dtype=np.int64)))
    return sums[words.ends] > sums[words.starts]


DIGITS = np.zeros(256, dtype=bool)
DIGITS[48:58] = True
