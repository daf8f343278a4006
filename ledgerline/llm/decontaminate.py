"""Benchmark passages in documents, re-parameterised ones included.

Numbers, names and units become typed placeholders. Windows of the canonical words of a document are looked up among those
of the benchmark, in four readings (``views``), so that neither the copy's case nor the length of a name hides a window;
hits on one diagonal are compared word by word with the item, and diagonals of one item that follow one another are chained.
The item's slots must be filled consistently: one value of the item always by the same value of the document, and never two
by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.words import BATCH_ROWS, DIGITS, Words, column, has_byte, mix, settings, stripped, unit_starts, window_hashes, word_slices
from ledgerline.session import stage

WINDOW = 8
LITERALS = 4  # a window with fewer words that are no placeholder is looked up by its exact values
COVERAGE = 0.5  # share of an item's words that a document must hold in place
BLOCK_ITEMS = 100_000  # benchmark items looked up in one pass over the documents
LITERAL, NUMBER, NAME, UNIT = range(4)
#: Unit words and signs.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter "
    "liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week "
    "weeks month months year years mph kph km/h m/s dollar dollars cent cents euro euros usd eur % percent degree degrees"
).split()


@dataclass
class Canonical:
    keys: np.ndarray  # hash of the word, or of its placeholder
    kinds: np.ndarray
    values: np.ndarray  # hash of the word itself
    bounds: np.ndarray
    first: int
    word: np.ndarray  # where each token begins, and the number of words at the end; a token may be a run of words

    @property
    def weights(self) -> np.ndarray:
        return np.diff(self.word)


def _of(texts: list[str]) -> np.ndarray:
    return np.concatenate([w.hashes() for w in word_slices(pa.array(texts, pa.string()))])


_UNIT_HASHES = np.sort(_of(UNITS))
_PLACEHOLDERS = mix(np.arange(11, 15, dtype=np.uint64))


def canonical(words: Words) -> Canonical:
    """Words without outer punctuation; a word with a digit is a number, one of ``UNITS`` a unit, a capitalised word inside
    a sentence a name."""
    plain = stripped(words)
    values = plain.hashes()
    kinds = np.zeros(len(values), dtype=np.int8)
    if len(values):
        head = words.data[plain.starts]
        upper = (head >= 65) & (head <= 90)
        upper[unit_starts(words)] = False
        kinds[upper] = NAME
        kinds[_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, values), len(_UNIT_HASHES) - 1)] == values] = UNIT
        kinds[has_byte(plain, DIGITS)] = NUMBER
    keys = np.where(kinds > 0, _PLACEHOLDERS[kinds], values)
    return Canonical(keys, kinds, values, words.bounds, words.first, np.arange(len(values) + 1))


def collapsed(c: Canonical) -> Canonical:
    """Each run of words of one placeholder as one token: 'New York City' and 'Paris' are both one name."""
    n = len(c.values)
    begins = np.ones(n, dtype=bool)
    begins[1:] = (c.kinds[1:] == LITERAL) | (c.kinds[1:] != c.kinds[:-1])
    begins[c.bounds[:-1][c.bounds[:-1] < n]] = True
    at = np.flatnonzero(begins)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    placed = mix(c.values + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values = np.add.reduceat(placed, at) if n else placed
    return Canonical(c.keys[at], c.kinds[at], values, np.searchsorted(at, c.bounds), c.first, np.append(at, n))


def views(c: Canonical, runs: Canonical) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of the tokens, and whether each is no placeholder, in four readings: by words, by words with names as they are
    (a copy in another case shows no names), by the values alone, and by runs."""
    counted = (c.kinds == NUMBER) | (c.kinds == UNIT)
    return [
        (c.keys, c.kinds == LITERAL),
        (np.where(counted, c.keys, c.values), ~counted),
        (c.values, np.ones(len(c.values), dtype=bool)),
        (runs.keys, runs.kinds == LITERAL),
    ]


RUNS = 3  # the view whose tokens are runs


def _one_to_one(kinds: np.ndarray, mine: np.ndarray, other: np.ndarray) -> tuple[bool, bool]:
    """Whether slots are filled one to one, and whether one has another value."""
    pairs = set(zip(kinds.tolist(), mine.tolist(), other.tolist()))
    fits = len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs})
    return fits, any(p[1] != p[2] for p in pairs)


def _beside(agree: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Whether the nearest ``fixed`` tokens on both sides agree, on one side at an end."""
    places = np.arange(len(agree))
    before = np.maximum.accumulate(np.where(fixed, places, -1))
    after = np.minimum.accumulate(np.where(fixed, places, len(agree))[::-1])[::-1]
    known = np.append(agree, True)  # for -1 and for the length
    return known[before] & known[after] & ((before >= 0) | (after < len(agree)))


def chain(agree: np.ndarray, shifts: np.ndarray) -> list[tuple[int, int]]:
    """(place in the item, number of the diagonal) of the agreeing tokens of the heaviest ordered chain over diagonals.

    ``agree`` has the weight of each agreeing token by place and diagonal, ``shifts`` ascend. A chain moves on in the item
    and in the document: to a later diagonal at the next place, to an earlier one past the words that the document lacks.
    """
    n, m = agree.shape
    total, back = np.zeros((n, m), dtype=np.int64), np.full((n, m), -1, dtype=np.int64)
    reach = np.searchsorted(shifts, shifts + n)
    count = reach - np.arange(m) - 1
    to = np.repeat(np.arange(m), count)
    of = np.arange(len(to)) - np.repeat(np.cumsum(count) - count, count) + to + 1
    lacks = shifts[of] - shifts[to]
    for j in range(n):
        best = np.zeros(m, dtype=np.int64)
        if j:
            best = np.maximum.accumulate(total[j - 1])
            back[j] = (j - 1) * m + np.maximum.accumulate(np.where(total[j - 1] == best, np.arange(m), 0))
            may = lacks < j
            places = (j - 1 - lacks[may]) * m + of[may]
            gains = total.ravel()[places]
            order = np.argsort(gains, kind="stable")
            gained, place = np.full(m, -1, dtype=np.int64), np.zeros(m, dtype=np.int64)
            gained[to[may][order]], place[to[may][order]] = gains[order], places[order]
            back[j] = np.where(gained > best, place, back[j])
            best = np.maximum(best, gained)
        total[j] = best + agree[j]
    found, at = [], (n - 1) * m + int(total[-1].argmax())
    while at >= 0:
        j, k = divmod(at, m)
        if agree[j, k]:
            found.append((j, k))
        at = int(back[j, k])
    return found[::-1]


class Benchmark:
    """The windows and words of a block of benchmark items, ready to be sent to every task."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = []
        hashes: list[list[np.ndarray]] = [[] for _ in range(RUNS + 1)]
        places: list[list[np.ndarray]] = [[] for _ in range(RUNS + 1)]
        for words in word_slices(pa.array([t for _, t in items], pa.string())):
            whole = canonical(words)
            for k, (at, to) in enumerate(zip(whole.bounds[:-1].tolist(), whole.bounds[1:].tolist())):
                if to == at:
                    continue
                part = (x[at:to] for x in (whole.keys, whole.kinds, whole.values))
                c = Canonical(*part, np.array([0, to - at]), 0, np.arange(to - at + 1))
                runs = collapsed(c)
                number = len(self.items)
                self.items.append((items[whole.first + k][0], c, runs))
                for view, (keys, literal) in enumerate(views(c, runs)):
                    size = min(WINDOW, len(keys))
                    wanted = np.convolve(literal, np.ones(size, dtype=int), "valid") >= min(LITERALS, size)
                    if view == 1:
                        exact = ~wanted
                    elif view == 2:
                        wanted = exact
                    place = np.flatnonzero(wanted)
                    hashes[view].append(window_hashes(keys, size)[place])
                    places[view].append(np.stack([np.full(len(place), number), place, np.full(len(place), size)], axis=1))
        self.index = []
        for own, where in zip(hashes, places):
            found = np.concatenate(own) if own else np.zeros(0, dtype=np.uint64)
            where = np.concatenate(where) if where else np.zeros((0, 3), dtype=np.int64)
            order = np.argsort(found, kind="stable")
            self.index.append((found[order], where[order], sorted(set(where[:, 2].tolist()))))

    def _diagonals(self, c: Canonical, runs: Canonical) -> dict[tuple[int, int], tuple[set[int], set[int]]]:
        """Shifts of the item's first token, by words and by runs, for (text, item), from windows that agree."""
        found: dict[tuple[int, int], tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))
        for view, (keys, _) in enumerate(views(c, runs)):
            index, places, sizes = self.index[view]
            bounds = (runs if view == RUNS else c).bounds
            for size in sizes:
                hashes = window_hashes(keys, size)
                low = np.searchsorted(index, hashes, side="left")
                hit = np.flatnonzero(low < len(index))
                hit = hit[index[low[hit]] == hashes[hit]]
                text = np.searchsorted(bounds, hit, side="right") - 1
                for at, t, k in zip(hit.tolist(), text.tolist(), low[hit].tolist()):
                    while k < len(index) and index[k] == hashes[at]:
                        number, place, own = places[k].tolist()
                        if own == size and at + size <= bounds[t + 1]:
                            found[t, number][view == RUNS].add(at - place)
                        k += 1
        return found

    def matches(self, words: Words) -> Iterator[tuple[int, int, int, int, float, bool]]:
        """(text, item id, first word, words that agree, share of the item, whether a slot has another value)."""
        c = canonical(words)
        runs = collapsed(c)
        for (text, number), both in self._diagonals(c, runs).items():
            item, *own = self.items[number]
            found = [x for d, i, shifts in zip((c, runs), own, both) if shifts for x in _best(d, i, text, np.array(sorted(shifts)))]
            if found:
                first, n, share, other = max(found, key=lambda x: x[2])
                yield words.first + text, item, first - int(c.word[c.bounds[text]]), n, share, other


def _best(c: Canonical, item: Canonical, text: int, shifts: np.ndarray) -> Iterator[tuple[int, int, float, bool]]:
    """The matches of an item with a text: (first word, words that agree, share of the item, whether a slot has another
    value), of its single diagonals, or without any of these, of the chain."""
    begin, end, n = int(c.bounds[text]), int(c.bounds[text + 1]), len(item.keys)
    weights, total = item.weights, int(item.word[-1])

    def agreeing(shift: int) -> tuple[np.ndarray, np.ndarray]:
        at, to = max(shift, begin), min(shift + n, end)
        part = slice(at - shift, to - shift)
        keys, kinds, values = item.keys[part], item.kinds[part], item.values[part]
        agree = (c.keys[at:to] == keys) | (c.values[at:to] == values)
        shown = c.kinds[at:to] == NAME
        if not shown.any() or not (c.kinds[at:to] == LITERAL).any():  # the case tells no names
            agree |= (kinds == NAME) & (c.kinds[at:to] != NUMBER) & _beside(agree, kinds != NAME)
        return np.arange(at - shift, to - shift)[agree], np.arange(at, to)[agree]

    def match(mine: np.ndarray, other: np.ndarray, first: int) -> tuple[int, int, float, bool] | None:
        words = int(weights[mine].sum())
        if words < COVERAGE * total:
            return None
        slots = item.kinds[mine] != LITERAL
        fits, changed = _one_to_one(item.kinds[mine][slots], item.values[mine][slots], c.values[other][slots])
        return (int(c.word[max(first, begin)]), words, words / total, changed) if fits else None

    single = [(shift, *agreeing(shift)) for shift in shifts.tolist()]
    found = [x for shift, mine, other in single if (x := match(mine, other, shift))]
    if not found and len(shifts) > 1:
        agree = np.zeros((n, len(shifts)), dtype=np.int64)
        for k, (_, mine, _) in enumerate(single):
            agree[mine, k] = weights[mine]
        mine, which = np.array(chain(agree, shifts)).T
        found = [x] if (x := match(mine, mine + shifts[which], int(shifts[which[0]]))) else []
    return iter(found)


MATCHES = "doc_id long, item_id long, first_word long, n_words long, coverage double, reparameterised boolean"


def _blocks(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in blocks of a bounded number of items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    n = items.count()
    blocks = max(1, -(-n // BLOCK_ITEMS))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Benchmark([(r[0], r[1]) for r in part.collect()])


def find_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) that it holds.

    The item's windows of 8 canonical words, or of runs of names, numbers or units, are looked up in the document; on the best
    diagonal, or without one on a chain of diagonals that follow one another in both, at least half of the item's words must
    agree, and its slots must be filled one to one. Windows with fewer than 4 literal words count with the item's own values
    only. Where a passage shows no names by its case, a word between words that agree may stand for a name. first_word is the item's place in the
    document, n_words the item's words that agree, reparameterised tells whether a slot has another value than in the item.

    An item shorter than a window is looked up whole. Defined cases: null or empty texts and items match nothing; null
    doc_ids and repeated rows each give rows of their own; other columns are ignored. The benchmark is sent to the tasks in
    blocks of 100,000 items, each block a pass over the documents, which are never shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = column(batch, "doc_id").to_pylist()
                rows = [(ids[t], *rest) for words in word_slices(column(batch, "text")) for t, *rest in block.matches(words)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                    names=["doc_id", "item_id", "first_word", "n_words", "coverage", "reparameterised"],
                )

        part = docs.mapInArrow(run, MATCHES)
        found = part if found is None else found.unionByName(part)
    return found


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item of the benchmark as :func:`find_benchmark` finds them."""
    schema = docs.schema
    blocks = _blocks(benchmark)
    block = next(blocks, None)
    while block is not None:

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for words in word_slices(column(batch, "text")):
                    for t, *_ in block.matches(words):
                        clean[t] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
        block = next(blocks, None)  # the driver holds no more blocks than this one and the last
        if block is not None:
            with settings(docs.sparkSession, BATCH_ROWS):
                docs = stage(docs, "decontaminated")
    return docs
