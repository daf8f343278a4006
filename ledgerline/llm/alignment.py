"""Token alignment across two tokenizers by merge-path partitioning.

Both tokenizers' token ends, as byte offsets, are two sorted lists. Where both have an end, they are cut into groups. The
merge of the lists is divided by binary searches along its diagonals into pieces of equal work, which run in lockstep; each
piece emits the ends that meet in it, and a pair that a diagonal separates is stitched by the piece that takes its second end.

Both vocabularies keep words apart, so a run from a space after a word to the next such space has the same tokens wherever it
stands and ends both a token of A and of B. Each run is encoded and aligned once in a task and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.token_counts import _byte_alphabet
from ledgerline.llm.words import BATCH_ROWS, column, settings
from ledgerline.session import stage

#: From a space that follows no white space to the next such one. No token of either kind reaches over these.
RUN = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
SLICE_CHARS = 1_000_000
MEMORY_RUNS = 300_000  # remembered runs of a task; beyond it the memory starts afresh, results stay the same
WIDE = 4096  # links in a group from which its ids are counted before they are paired
FREQUENT = 1_000_000  # pairs whose counts travel to every task, 16 bytes each; the others meet their counts in a join
MOST = (1 << 32) - 1


def diagonal_starts(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``a`` and ``b`` each piece of ``work`` steps of their merge begins; equal values come from ``a`` first."""
    diagonals = np.arange(0, len(a) + len(b), work)
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = open_.copy()
        first[open_] = a[middle[open_]] <= b[diagonals[open_] - 1 - middle[open_]]
        low = np.where(first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    return low, diagonals - low


def common_ends(a: np.ndarray, b: np.ndarray, work: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the values that the strictly growing lists ``a`` and ``b`` share."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    work = work or max(16, isqrt(total))
    i, j = diagonal_starts(a, b, work)
    steps = np.minimum(work, total - work * np.arange(len(i)))
    found = []
    for step in range(work):
        going = steps > step
        more_a, more_b = i < len(a), j < len(b)
        here_a, here_b = a[np.minimum(i, len(a) - 1)], b[np.minimum(j, len(b) - 1)]
        take_a = going & more_a & (~more_b | (here_a <= here_b))
        take_b = going & ~take_a
        met = take_b & (i > 0) & (a[np.maximum(i, 1) - 1] == here_b)  # the end of A just before may lie in the piece before
        found.append(np.stack((i[met] - 1, j[met])))
        i, j = i + take_a, j + take_b
    ends = np.concatenate(found, axis=1)
    order = np.argsort(ends[0])
    return ends[0][order], ends[1][order]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges of ``sizes`` numbers from ``starts`` on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def group_links(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, shift: int) -> tuple[np.ndarray, ...]:
    """(group, code, times) of the linked ids of groups that end at the tokens ``ends_a`` and ``ends_b``."""
    starts_a, starts_b = np.append(0, ends_a[:-1] + 1), np.append(0, ends_b[:-1] + 1)
    n_a, n_b = ends_a + 1 - starts_a, ends_b + 1 - starts_b
    links = n_a * n_b
    few = np.flatnonzero(links <= WIDE)
    group = np.repeat(few, links[few])
    place = _ragged(np.zeros(len(few), dtype=np.int64), links[few])
    codes = (a[starts_a[group] + place // n_b[group]] << shift) | b[starts_b[group] + place % n_b[group]]
    parts = [(group, codes, np.ones(len(codes), dtype=np.int64))]
    for g in np.flatnonzero(links > WIDE).tolist():
        left, times_a = np.unique(a[starts_a[g] : ends_a[g] + 1], return_counts=True)
        right, times_b = np.unique(b[starts_b[g] : ends_b[g] + 1], return_counts=True)
        pairs = ((left[:, None] << shift) | right[None, :]).ravel()
        parts.append((np.full(len(pairs), g), pairs, np.outer(times_a, times_b).ravel()))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def _starts(lists: list[list[int]]) -> np.ndarray:
    sizes = np.fromiter(map(len, lists), dtype=np.int64)
    return np.cumsum(sizes) - sizes


def runs_of(text: str) -> list[str]:
    """The runs of a space and the text; a last single space, which B would not see alone, stays with the run before it."""
    runs = RUN.findall(" " + text)
    if runs[-1] == " ":
        runs[-2:] = ["".join(runs[-2:])]
    return runs


class Aligner:
    """Encodes and aligns runs of text, and remembers them."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        alphabet = _byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)  # a token that is no bytes never gives a text back
        for token, i in vocabulary.items():
            if all(c in alphabet for c in token):
                self.bytes_a[i] = bytes(alphabet[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("a piece of B reaches over a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in kind], dtype=np.int64) for kind in (self.bytes_a, self.bytes_b))
        self.shift = (len(pieces) - 1).bit_length()
        if (len(self.bytes_a) - 1) << self.shift >> 32:
            raise ValueError("ids of both vocabularies do not fit in 32 bits")
        self.written = [f"{i}{mark}" for n, marks in ((len(self.bytes_a), ",|"), (len(pieces), ",;")) for i in range(n) for mark in marks]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.figures = np.zeros((4, 0), dtype=np.int64)  # tokens of A and B, groups, links; -1 where the bytes differ
        self.code_sizes = np.zeros(0, dtype=np.int64)
        self.codes = np.zeros(0, dtype=np.int64)
        self.times = np.zeros(0, dtype=np.int64)

    def _kept(self, runs: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> np.ndarray:
        """Which runs both tokenizers give back byte by byte."""

        def back(table: list[bytes], ids: Iterable[int]) -> bytes:
            return b"".join(map(table.__getitem__, ids))

        raw = "".join(runs).encode()
        if back(self.bytes_a, chain.from_iterable(ids_a)) == raw == back(self.bytes_b, chain.from_iterable(ids_b)):
            sizes = np.fromiter(map(len, map(str.encode, runs)), dtype=np.int64)  # all together agree; each one must as well
            lengths = [np.add.reduceat(np.append(table[np.fromiter(chain.from_iterable(ids), dtype=np.int64)], 0), _starts(ids)) for table, ids in ((self.length_a, ids_a), (self.length_b, ids_b))]
            if all(map(len, ids_a)) and all(map(len, ids_b)) and (lengths[0] == sizes).all() and (lengths[1] == sizes).all():
                return np.ones(len(runs), dtype=bool)
        raws = map(str.encode, runs)
        return np.array([back(self.bytes_a, x) == r == back(self.bytes_b, y) for r, x, y in zip(raws, ids_a, ids_b)])

    def learn(self, runs: list[str]) -> None:
        """Encode new runs, align them in one merge over all, and remember the results."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(runs, add_special_tokens=False)]
        ids_b = self.b.encode([r[1:] for r in runs], num_threads=1)  # B adds the first space itself
        good = self._kept(runs, ids_a, ids_b)
        if not good.all():
            ids_a, ids_b = ([x if g else [] for x, g in zip(ids, good)] for ids in (ids_a, ids_b))
        size_a, size_b = (np.fromiter(map(len, ids), dtype=np.int64) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), dtype=np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = common_ends(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        run_of_group = np.searchsorted(np.cumsum(size_a), ends_a, side="right")
        n_groups = np.bincount(run_of_group, minlength=len(runs))
        group, codes, times = group_links(a, b, ends_a, ends_b, self.shift)
        owner = run_of_group[group]
        order = np.argsort(owner, kind="stable")
        n_links = np.zeros(len(runs), dtype=np.int64)
        np.add.at(n_links, owner, times)

        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[ends_a] = last_b[ends_b] = 1
        place = np.concatenate((2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1))  # group, A before B
        shown = np.concatenate((2 * a + last_a, 2 * (len(self.bytes_a) + b) + last_b))[np.argsort(place, kind="stable")]
        tokens = list(map(self.written.__getitem__, shown.tolist()))
        bounds = np.append(0, np.cumsum(size_a + size_b)).tolist()
        self.known.update(zip(runs, range(len(self.groups), len(self.groups) + len(runs))))
        self.groups += ["".join(tokens[x:y]) for x, y in zip(bounds, bounds[1:])]
        figures = np.stack((size_a, size_b, np.where(good, n_groups, -1), n_links))
        self.figures = np.concatenate((self.figures, figures), axis=1)
        self.code_sizes = np.append(self.code_sizes, np.bincount(owner, minlength=len(runs)))
        self.codes, self.times = np.append(self.codes, codes[order]), np.append(self.times, times[order])

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """For each text its figures, the digest of its groups, and its distinct linked pairs with how often."""
        runs = [runs_of(t) if t else [] for t in texts]
        new = list(dict.fromkeys(r for rs in runs for r in rs if r not in self.known))
        if new:
            if len(self.known) + len(new) > MEMORY_RUNS:
                self.forget()
                new = list(dict.fromkeys(r for rs in runs for r in rs))
            self.learn(new)
        starts = np.cumsum(self.code_sizes) - self.code_sizes
        for rs in runs:
            rows = list(map(self.known.__getitem__, rs))
            at = np.array(rows, dtype=np.int64)
            figures = self.figures[:, at]
            if not rows or (figures[2] < 0).any():
                yield np.zeros(4, dtype=np.int64), "", at[:0], at[:0]
                continue
            digest = hashlib.sha256("".join(map(self.groups.__getitem__, rows))[:-1].encode()).hexdigest()
            run, often = np.unique(at, return_counts=True)
            places = _ragged(starts[run], self.code_sizes[run])
            codes, times = self.codes[places], self.times[places] * np.repeat(often, self.code_sizes[run])
            order = np.argsort(codes)
            codes, times = codes[order], times[order]
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            yield figures.sum(axis=1), digest, codes[first], np.add.reduceat(times, first)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _packed(codes: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Codes and times as 32-bit numbers; a code that is linked more often than that holds comes again."""
    if len(times) and times.max() > MOST:
        again = -(-times // MOST)
        codes = np.repeat(codes, again)
        rest = np.repeat(times, again) - _ragged(np.zeros(len(again), dtype=np.int64), again) * MOST
        times = np.minimum(rest, MOST)
    return codes.astype("<u4").tobytes(), times.astype("<u4").tobytes()


ALIGNED = "row_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = aligner(path_a, path_b)
        for batch in batches:
            texts, sizes = column(batch, "text"), pa.compute.utf8_length(column(batch, "text")).fill_null(0).to_numpy()
            at = 0
            while at < batch.num_rows:
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_CHARS, side="right")))
                found = list(tokens.align(texts[at:to].to_pylist()))
                packed = [_packed(codes, times) for *_, codes, times in found]
                figures = np.stack([f for f, *_ in found], axis=1)
                arrays = [column(batch, "row_key")[at:to], column(batch, "doc_id")[at:to], *(pa.array(f) for f in figures)]
                arrays += [pa.array([d for _, d, *_ in found]), *(pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in ALIGNED.split(", ")])
                at = to

    return run


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and times of a batch's rows in a row, and the row of each."""
    lists = [[np.frombuffer(x, dtype="<u4") for x in column(batch, c).to_pylist()] for c in ("codes", "times")]
    codes, times = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in lists)
    return codes, times, np.repeat(np.arange(batch.num_rows), [len(x) for x in lists[0]])


def _documents_by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, _, row = _unpacked(batch)
        again = np.zeros(len(codes), dtype=bool)
        again[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
        found, n = np.unique(codes[~again], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["code", "n"])


def align_tokens(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): tokens of A and B, groups between common ends, links, and what the corpus says of them.

    A link is a pair of tokens of A and B in one group. A pair of ids counts the rows that have it linked; n_best counts the
    links whose pair is its A id's most frequent, count_sum adds the counts over all links. ``path_a`` is a byte-level file of
    ``tokenizers``, ``path_b`` a ``sentencepiece`` model that adds a space; every executor can open both. The counts of the
    ``frequent`` most frequent pairs travel to the tasks, all others meet their documents in a join.

    Defined cases: a text that is null, empty, or that either tokenizer does not give back byte by byte has no tokens, zeros
    and an empty digest; a null doc_id and repeated rows stay, each row a document of its own in the counts; other columns are
    ignored; no rows give no rows. Texts are encoded once and never shuffled.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.monotonically_increasing_id().alias("row_key"), docs["doc_id"].cast("long").alias("doc_id"), "text")
    with settings(spark, BATCH_ROWS):
        aligned = stage(keyed.mapInArrow(_aligned(path_a, path_b), ALIGNED), "aligned")
        pairs = aligned.select("codes", F.col("codes").alias("times")).mapInArrow(_documents_by_pair, "code long, n long")
        pairs = stage(pairs.groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    shift = aligner(path_a, path_b).shift
    best = pairs.groupBy(F.shiftright("code", shift).alias("a")).agg(F.max("n").alias("n")).toPandas()  # a row per id of A at most
    few = pairs.count() <= frequent
    common = (pairs if few else pairs.orderBy(F.desc("n"), "code").limit(frequent)).toPandas().sort_values("code")
    sent = spark.sparkContext.broadcast((common["code"].to_numpy(), common["n"].to_numpy(), _by_id(best)))

    def known(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, counts, _ = sent.value
        if not len(have):
            return np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=np.int64)
        at = np.minimum(np.searchsorted(have, codes), len(have) - 1)
        return have[at] == codes, counts[at]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times, row = _unpacked(batch)
            there, n = known(codes)
            sums = np.zeros((2, batch.num_rows), dtype=np.int64)
            np.add.at(sums[0], row[there], (times * (n == sent.value[2][codes >> shift]))[there])
            np.add.at(sums[1], row[there], (times * n)[there])
            arrays = [column(batch, c) for c in names] + [pa.array(s) for s in sums]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times, row = _unpacked(batch)
            left = ~known(codes)[0]
            best_n = sent.value[2][codes[left] >> shift]
            arrays = [column(batch, "row_key").to_numpy()[row[left]], codes[left], times[left], best_n]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["row_key", "code", "times", "best"])

    names = ["row_key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    result = aligned.mapInArrow(summed, ALIGNED.replace(", codes binary, times binary", ", n_best long, count_sum long"))
    if not few:
        late = aligned.select("row_key", "codes", "times").mapInArrow(rest, "row_key long, code long, times long, best long").join(pairs, "code")
        late = late.groupBy("row_key").agg(
            F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("late_best"), F.sum(F.col("times") * F.col("n")).alias("late_sum")
        )
        result = result.join(late, "row_key", "left").withColumns(
            {"n_best": F.col("n_best") + F.coalesce("late_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("late_sum", F.lit(0))}
        )
    return result.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _by_id(best: pd.DataFrame) -> np.ndarray:
    counts = np.zeros(int(best["a"].max()) + 1 if len(best) else 1, dtype=np.int64)
    counts[best["a"].to_numpy()] = best["n"].to_numpy()
    return counts
